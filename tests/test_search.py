import math

import numpy as np
import pytest

from leitmotiv.config import MotifConfig
from leitmotiv.functions.random import gaussian
from leitmotiv.operators import distance, exact, lsh, topk, windows
from leitmotiv.operators.distance import pair_distances
from leitmotiv.plans import evaluate, search
from leitmotiv.sources import synthetic


def frame(spark, x):
    rows = [("s", t, m, None if x[t, m] is None else float(x[t, m])) for t in range(len(x)) for m in range(x.shape[1])]
    return spark.createDataFrame(rows, "series_id string, t bigint, dim int, value double")


def noise(n, dims, seed=1):
    return np.array([[gaussian(seed, m, t) for m in range(dims)] for t in range(n)])


def planted(n=300, dims=5, w=30, at=(40, 180)):
    x = noise(n, dims)
    shape = np.sin(np.arange(w) * 0.9) + np.cos(np.arange(w) * 0.37)
    for k, p in enumerate(at):
        for m in (0, 1):
            x[p : p + w, m] = shape * (10 + 7 * k) + 3 * m + k
    return x


def brute(x, w, d):
    """All admissible pairs as (distance, a, b, dims)."""
    n = len(x) - w + 1
    z = np.stack([x[t : t + w] for t in range(n)])
    std = z.std(1, keepdims=True)
    z = (z - z.mean(1, keepdims=True)) / np.where(std == 0, 0.001, std)
    out = []
    for a in range(n):
        for b in range(a + w + 1, n):
            dist = np.sqrt(((z[a] - z[b]) ** 2).sum(0))
            order = np.argsort(dist, kind="stable")[:d]
            out.append((dist[order].sum(), a, b, order.tolist()))
    return sorted(out)


def greedy(pairs, k, w):
    out = []
    for p in pairs:
        if all(abs(p[i] - q[j]) >= w for q in out for i in (1, 2) for j in (1, 2)):
            out.append(p)
            if len(out) == k:
                break
    return out


CFG = MotifConfig(window=30, low=2, high=2, k=1, K=4, L=20, delta=0.01, r=8, batch=10, may_end_exact=False)


def test_planted_is_found_by_all_searches(spark):
    points = frame(spark, planted()).cache()
    for rows in (search.find_motifs(points, CFG).motifs.collect(), search.find_motifs(points, CFG, resident=10).motifs.collect(), exact.exact_motifs(points, 30, 2, 2).collect()):
        (m,) = rows
        assert (m["a"], m["b"], sorted(m["dims"])) == (40, 180, [0, 1]) and m["distance"] < 1e-6
    assert search.find_motifs(points, MotifConfig(window=30, low=2, high=2, K=4, L=20), resident=10).motifs.first()["a"] == 40  # own bin width
    (m,) = search.find_motifs_sax(points, 30, 2, 5).collect()
    assert abs(m["a"] - 40) < 30 and abs(m["b"] - 180) < 30


def test_exact_is_brute_force(spark):
    x, w = noise(70, 3), 6
    points = frame(spark, x).cache()
    for d in (2, 3):
        want = greedy(brute(x, w, d), 3, w)
        got = sorted(exact.exact_motifs(points, w, d, d, 3, keep=4).collect(), key=lambda m: m["rank"])
        assert [(m["a"], m["b"], m["dims"]) for m in got] == [p[1:] for p in want]
        assert np.allclose([m["distance"] for m in got], [p[0] for p in want])
    assert pair_distances(points, w).count() == len(brute(x, w, 2))


@pytest.mark.parametrize("side", [1, 32])
def test_cells_of_many_tiles_and_many_cells(spark, monkeypatch, side):
    monkeypatch.setattr(distance, "SIDE", side)  # one cell of nine tiles, or six cells of one
    x, w = noise(600, 2), 6
    points, pairs = frame(spark, x).cache(), brute(x, w, 2)
    (m,) = exact.exact_motifs(points, w, 2, 2).collect()
    assert (m["a"], m["b"]) == pairs[0][1:3]
    want = {}
    for dist, a, b, _ in reversed(pairs):
        want[a] = want[b] = dist
    got = {r["t"]: r["distance"] for r in exact.matrix_profile(points, w, 2, 2).collect()}
    assert got.keys() == want.keys() and np.allclose([got[t] for t in want], list(want.values()))


def test_gaps_and_missing_dimensions_end_windows(spark):
    """Windows over a t that is absent, or that one dimension lacks, are none; t may start anywhere."""
    x = noise(60, 2)
    points = frame(spark, x).where("t <> 20 and not (t = 40 and dim = 1)").selectExpr("series_id", "t + 1000 as t", "dim", "value")
    starts = [t for t in range(56) if not {20, 40} & set(range(t, t + 5))]
    got = {(r["a"] - 1000, r["b"] - 1000) for r in pair_distances(points, 5).collect()}
    assert got == {(a, b) for a in starts for b in starts if b - a > 5}
    assert exact.exact_motifs(points.where("t < 1004"), 5, 1, 1).isEmpty() and exact.exact_motifs(points.limit(0), 5, 1, 1).isEmpty()


def test_search_to_the_end_is_exact(spark):
    """Down to prefixes of one code with many repetitions, hashing finds what all pairs give."""
    x, w = noise(80, 3), 6
    points = frame(spark, x).cache()
    want = [p[1:3] for p in greedy(brute(x, w, 2), 2, w)]
    cfg = MotifConfig(window=w, low=2, high=2, k=2, K=2, L=60, delta=1e-9, r=16, batch=30, may_end_exact=False)
    got = sorted(search.find_motifs(points, cfg).motifs.collect(), key=lambda m: m["rank"])
    assert [(m["a"], m["b"]) for m in got] == want


def test_range_equals_fixed(spark):
    points = frame(spark, noise(60, 4)).cache()
    key = lambda m: (m["d"], m["rank"], m["a"], m["b"], m["dims"])
    ranged = sorted(map(key, exact.exact_motifs(points, 5, 2, 4, 2).collect()))
    assert ranged == sorted(key(m) for d in (2, 3, 4) for m in exact.exact_motifs(points, 5, d, d, 2).collect())


def test_motifs_dont_overlap(spark):
    rows = exact.exact_motifs(frame(spark, noise(120, 3)), 6, 2, 2, 4).collect()
    ends = [(m["a"], m["b"]) for m in rows]
    assert len(ends) == 4
    assert all(abs(p - q) >= 6 for i, x in enumerate(ends) for y in ends[i + 1 :] for p in x for q in y)


def test_permuted_and_rescaled_dimensions(spark):
    x = noise(60, 4)
    (m,) = exact.exact_motifs(frame(spark, x), 5, 2, 2).collect()
    (p,) = exact.exact_motifs(frame(spark, x[:, [3, 1, 0, 2]] * np.array([2.0, 5.0, 0.5, 9.0]) + 4), 5, 2, 2).collect()
    back = {0: 3, 1: 1, 2: 0, 3: 2}
    assert (m["a"], m["b"]) == (p["a"], p["b"]) and m["dims"] == [back[k] for k in p["dims"]] and math.isclose(m["distance"], p["distance"])


def test_copies_and_flat_dimensions(spark):
    x = noise(60, 3)
    x[40:50] = x[10:20]
    x[:, 2] = 7.0
    points = frame(spark, x).cache()
    (m,) = exact.exact_motifs(points, 8, 3, 3).collect()
    assert m["distance"] == 0 and m["b"] - m["a"] == 30
    got = search.find_motifs(points, MotifConfig(window=8, low=3, high=3, k=1, K=4, L=10, batch=10, r=4))
    assert got.motifs.first()["distance"] < 1e-9 and got.stopped_early
    assert windows.subsequences(points, 8).where("dim = 2 and z[0] <> 0").count() == 0


def test_a_flat_dimension_is_not_joined_with_itself(spark, monkeypatch):
    """All its windows share a bucket, whose pairs are more than the exact search compares."""
    x = noise(300, 3)
    x[:, 2] = 7.0
    points = frame(spark, x).cache()
    want = exact.exact_motifs(points, 8, 2, 2).first()

    def joined(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(lsh, "candidates", joined)
    got = search.find_motifs(points, MotifConfig(window=8, low=2, high=2, k=1, K=4, L=10, r=4), resident=10).motifs.first()
    assert (got["a"], got["b"], got["distance"]) == (want["a"], want["b"], want["distance"])


def test_gap_of_exactly_the_window(spark):
    pairs = pair_distances(frame(spark, noise(20, 2)), 5).select("a", "b").collect()
    assert min(p["b"] - p["a"] for p in pairs) == 6


def test_missing_values_and_transposed_input(spark):
    x = planted().astype(object)
    x[5, 3], x[6, 3] = None, math.nan
    with pytest.warns(UserWarning):
        got = search.discover(frame(spark, x), 30, 1, (2, 2), K=4, L=20, r=8, batch=10)
    assert (got.motifs.first()["a"], got.motifs.first()["b"]) == (40, 180)
    wide = frame(spark, planted().T)
    got = search.discover(wide, 30, 1, (2, 2), K=4, L=20, r=8, batch=10)
    assert (got.motifs.first()["a"], got.motifs.first()["b"]) == (40, 180)


@pytest.mark.parametrize("options", [{"low": 1}, {"low": 3, "high": 2}, {"high": 9}, {"window": 99}, {"K": 5}, {"delta": 0}])
def test_invalid(spark, options):
    base = {"window": 5, "low": 2, "high": 2, "k": 1, "K": 4, "L": 4} | options
    with pytest.raises(ValueError):
        search.find_motifs(frame(spark, noise(30, 3)), MotifConfig(**base))


def test_one_dimension_is_refused(spark):
    with pytest.raises(ValueError):
        search.find_motifs(frame(spark, noise(30, 1)), MotifConfig(window=5, low=2, high=2, K=4, L=4))


def test_anytime_only_gets_better(spark):
    cfg = MotifConfig(window=6, low=2, high=2, k=1, K=4, L=20, delta=1e-9, r=4, batch=10, may_end_exact=False)
    seen = [r.motifs.first() for r in search.anytime(frame(spark, noise(80, 3)).cache(), cfg)]
    found = [m["distance"] for m in seen if m]
    assert found == sorted(found, reverse=True) and len(seen) > 1


def test_no_close_pairs_end_in_the_exact_search(spark):
    """Pure noise: hashing compares as much as there is, then the exact search decides."""
    x, w = noise(90, 3), 6
    points = frame(spark, x).cache()
    got = search.find_motifs(points, MotifConfig(window=w, low=2, high=2, k=2, K=4, L=100, delta=1e-12, r=16))
    want = [p[1:3] for p in greedy(brute(x, w, 2), 2, w)]
    assert [(m["a"], m["b"]) for m in sorted(got.motifs.collect(), key=lambda m: m["rank"])] == want
    assert got.repetitions < 400


def test_chunked_windows_equal_whole_ones(spark):
    points = frame(spark, noise(100, 2)).cache()
    rows = lambda df: sorted((r["dim"], r["t"], round(r["mean"], 9), round(r["std"], 9)) for r in df.collect())
    assert rows(windows.window_stats(points, 7)) == rows(windows.window_stats(points, 7, chunk=16))
    means = lambda df: sorted((r["dim"], r["t"], round(r["value"], 9)) for r in df.collect())
    assert means(windows.moving_average(points, 3)) == means(windows.moving_average(points, 3, chunk=16))


def test_smoothing_keeps_a_line(spark):
    x = np.stack([np.arange(50) * 2.0 + 1, 5 - np.arange(50)], 1)
    out = windows.savitzky_golay(frame(spark, x), 9).collect()
    assert len(out) == 100 and all(math.isclose(r["value"], x[r["t"], r["dim"]], abs_tol=1e-6) for r in out)


def test_longer_prefixes_have_fewer_candidates(spark):
    z = windows.subsequences(frame(spark, noise(60, 3)), 6).cache()
    sig = lsh.signatures(z, lsh.Projections(6, 4, 4, 4.0, 7)).cache()
    pairs = [{(r["a"], r["b"]) for r in lsh.candidates(sig, p, 2, 6).collect()} for p in (4, 3, 2)]
    assert pairs[0] <= pairs[1] <= pairs[2] and pairs[2]


def test_signatures_from_points(spark):
    """With chunks, halos and a gap, those of the windows that the SQL way makes."""
    points = frame(spark, noise(70, 2)).where("t <> 33").cache()
    p = lsh.Projections(6, 4, 4, 4.0, 7)
    rows = lambda df: sorted((r["t"], r["dim"], r["l"], tuple(r["code"])) for r in df.collect())
    z = windows.subsequences(points, 6)
    assert rows(lsh.point_signatures(points, 6, p, chunk=16)) == rows(lsh.signatures(z, p))
    starts = spark.createDataFrame([("s", t) for t in (0, 15, 16, 31, 64, 99)], "series_id string, t bigint")
    got = {r["t"]: r["z"] for r in lsh.windows_at(points, starts, 6, chunk=16).collect()}
    assert sorted(got) == [0, 15, 16, 64]
    want = {(r["t"], r["dim"]): r["z"] for r in z.collect()}
    assert all(np.allclose(got[t][m], want[t, m]) for t in got for m in (0, 1))


def test_recall_over_seeds(spark):
    x = planted(n=200, w=20, at=(30, 120))
    x[30:50] += 0.3 * noise(20, 5, 9)
    points = frame(spark, x).cache()
    truth = exact.exact_motifs(points, 20, 2, 2).first()["distance"]
    hits = [search.find_motifs(points, MotifConfig(window=20, low=2, high=2, K=4, L=20, delta=0.05, r=8, seed=s, batch=20, may_end_exact=False)).motifs.first()["distance"] for s in range(5)]
    assert sum(h - truth < 1e-6 for h in hits) >= 4


def test_noise_dimensions_dont_displace_a_motif(spark):
    base = synthetic.planted(spark, 200, 3, 20, 2, (30, 120)).cache()
    cfg = MotifConfig(window=20, low=2, high=2, K=4, L=20, r=8, batch=20)
    assert [r["stable"] for r in evaluate.noise_stability(base, 200, 3, cfg, (2, 4)).collect()] == [True, True]


def test_occurrences_and_highlight(spark):
    x = planted(n=400, at=(40, 180, 300))
    points = frame(spark, x).cache()
    motif = exact.exact_motifs(points, 30, 2, 2)
    found = exact.occurrences(windows.subsequences(points, 30), motif, 30).collect()
    (m,) = motif.collect()
    assert {m["a"], m["b"], *(r["t"] for r in found)} == {40, 180, 300}
    assert exact.highlight(points, motif, 30).count() == 2 * 2 * 30


def test_several_series_and_gaps_are_refused(spark):
    points = frame(spark, noise(60, 2)).cache()
    cfg = MotifConfig(window=6, low=2, high=2, K=4, L=4)
    other = points.selectExpr("'q' as series_id", "t", "dim", "value")
    with pytest.raises(ValueError, match="one series"):
        search.find_motifs(points.unionByName(other), cfg)
    far = points.selectExpr("series_id", "if(t = 59, 1000000000000, t) as t", "dim", "value")
    with pytest.raises(ValueError, match="gaps"):
        search.find_motifs(far, cfg)


def test_top_past_the_rank_limit(spark):
    rows = spark.range(6000).selectExpr("'s' as series_id", "id % 2 as d", "id as a", "id + 50 as b", "cast(pmod(xxhash64(id), 997) as double) as distance").cache()
    got = sorted((r["d"], r["distance"], r["a"]) for r in topk.top(rows, 1500, "series_id", "d").collect())
    want = sorted((r["d"], r["distance"], r["a"]) for r in rows.collect())
    assert got == [x for d in (0, 1) for x in [w for w in want if w[0] == d][:1500]]


def test_later_motifs_of_a_smooth_series(spark):
    """The neighbours (p + i, q + i) of the best pair fill any short list; the others come all the same, in both plans."""
    x = planted(400, 2, 40, (20, 150))
    t = np.arange(len(x))
    x[:, 0], x[:, 1] = np.sin(t * 0.05) * 5 + 0.05 * x[:, 0], np.cos(t * 0.05) * 5 + 0.05 * x[:, 1]
    points = frame(spark, x).cache()
    cfg = MotifConfig(window=40, low=2, high=2, k=3, K=2, L=4, delta=0.01, r=32, batch=4, may_end_exact=False)
    got = lambda resident: [(m["rank"], m["a"], m["b"]) for m in sorted(search.find_motifs(points, cfg, resident).motifs.collect(), key=lambda m: m["rank"])]
    want = got(10)
    assert len(want) == 3 and got(10**6) == want
