"""All pairs in tiles, against every pair in full."""

import math
import re

import numpy as np
import pytest

from leitmotiv.operators import distance, exact, tiles
from leitmotiv.operators.windows import ZERO_STD
from leitmotiv.plans import queries


def frame(spark, x):
    return spark.createDataFrame([("s", t, m, float(v)) for t, row in enumerate(x) for m, v in enumerate(row)], "series_id string, t bigint, dim int, value double")


def series(n=700, dims=4, copies=False):
    x = np.random.default_rng(5).normal(size=(n, dims)).round(2)
    if copies:
        x[n // 2 : n // 2 + 40] = x[20:60]
        x[100:130] = 1.0  # flat, so many ties
    return x


def whole(x, w, least):
    """a, b and the distances, pairs x dimensions, of all pairs."""
    z = np.lib.stride_tricks.sliding_window_view(x, w, axis=0)
    std = z.std(2, keepdims=True)
    z = (z - z.mean(2, keepdims=True)) / np.where(std == 0, ZERO_STD, std)
    a, b = np.nonzero(np.arange(len(z))[None, :] - np.arange(len(z))[:, None] > least)
    return a, b, np.sqrt(((z[a] - z[b]) ** 2).sum(2))


@pytest.mark.parametrize("w,copies", [(8, False), (8, True), (40, False)])
def test_profile_and_best_pairs(spark, monkeypatch, w, copies):
    monkeypatch.setattr(distance, "SIDE", 1)  # cells of several tiles
    x = series(copies=copies)
    a, b, dist = whole(x, w, w)
    running = np.cumsum(np.sort(dist, 1), 1)
    got = exact.matrix_profile(frame(spark, x), w, 2, 4).collect()
    assert len(got) == 3 * (len(x) - w + 1)
    for r in got[:: 50]:
        mine = (a == r.t) | (b == r.t)
        far, other = running[mine, r.d - 1], np.where(a == r.t, b, a)[mine]
        assert r.distance == pytest.approx(far.min(), abs=1e-9) and far[other == r.neighbour][0] == pytest.approx(far.min(), abs=1e-9)
        if copies and far.min() == 0:
            assert r.neighbour == other[far == 0].min()
    for d in (2, 3):
        found = sorted((r.distance, r.a, r.b) for r in exact.best_pairs(frame(spark, x), w, 2, 3, 30).where(f"d = {d}").collect())[:30]
        assert [r[0] for r in found] == pytest.approx(np.sort(running[:, d - 1])[:30].tolist(), abs=1e-9)


def test_summaries(spark):
    x = series(copies=True)
    a, b, dist = whole(x, 8, 8)
    for high, values in ((None, dist), (4, np.cumsum(np.sort(dist, 1), 1))):
        for r in distance.summary(frame(spark, x), 8, high).collect():
            v = values[:, r.n - (1 if high else 0)]
            assert r.pairs == len(a)
            assert [r.least, r.most, r.mean] == pytest.approx([v.min(), v.max(), v.mean()], abs=1e-7)


def test_later_windows_are_counted(spark):
    got = exact.nearest_others(frame(spark, series(300)), 8, range(2, 3), "a").select("t", "later").collect()
    assert {r.t: r.later for r in got} == {t: 293 - t - 9 for t in range(284)}


def test_contrast_of_exact_copies_is_infinite(spark):
    x = series(200)
    x[100:140] = x[20:60]
    profile = exact.matrix_profile(frame(spark, x), 8, 2, 2)
    assert exact.relative_contrast(profile).first().contrast == math.inf
    assert exact.profile_contrast(profile).first().contrast == math.inf


ALL_PAIRS = [
    "exact_top1", "exact_topk_ranked", "matrix_profile_d", "matrix_profile_index", "relative_contrast", "profile_contrast", "motif_highlight", "motif_occurrences",
    "motif_occurrence_list", "subdim_best_d", "subdim_profile_cumulative", "pair_dim_distance",
]


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_cells_keep_their_tasks_and_return_no_pairs(spark, sf, name):
    text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text  # else their few bytes are merged into a task or two
    assert not re.search(r"FlatMapGroupsInArrow.*\ba#\d+L, b#\d+L, dist#", text)


def test_error_is_a_bound():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(3, 400, 8))
    z = (z - z.mean(2, keepdims=True)) / z.std(2, keepdims=True)
    z[:, 200:210] = z[:, :10] + 1e-4
    cell = tiles.Cell(np.arange(128), z[:, :128], np.arange(200, 400), z[:, 200:], 8)
    for m, d in enumerate(cell.distances(slice(0, 128), slice(0, 200))):
        assert np.abs(d - np.sqrt(((z[m, :128, None] - z[m, None, 200:]) ** 2).sum(2))).max() < cell.error
