"""Repetitions whose buckets hold many pairs, compared in tiles, against listing the pairs."""

import numpy as np
import pytest

from leitmotiv.config import MotifConfig
from leitmotiv.operators import lsh
from leitmotiv.plans import search


@pytest.mark.parametrize("dims,least", [(4, 2), (12, 4)])
def test_tiles_find_what_lists_find(monkeypatch, dims, least):
    x = np.random.default_rng(4).normal(size=(600, dims))
    cfg = MotifConfig(window=8, low=least, high=least + 1, K=4, L=4, r=8.0)
    kernel = search.Kernel(x, cfg, lsh.Projections(8, 4, 4, 8.0, 7))
    ds = [least, least + 1]
    for taken in ([], [(10, 200), (300, 420)]):
        monkeypatch.setattr(search, "PAIRS_AT_ONCE", 10**12)
        listed = kernel.search(1, 2, ds, taken)
        monkeypatch.setattr(search, "PAIRS_AT_ONCE", 1)
        assert kernel.dense(kernel.keys(1, 2), least)
        tiled = kernel.search(1, 2, ds, taken)
        assert [(r["d"], r["a"], r["b"], r["dims"]) for r in tiled[0]] == [(r["d"], r["a"], r["b"], r["dims"]) for r in listed[0]]
        assert [r["distance"] for r in tiled[0]] == pytest.approx([r["distance"] for r in listed[0]])
        assert tiled[1].keys() == listed[1].keys() and tiled[2] <= listed[2]  # a list counts a pair again on each choice of dimensions


def test_repeats_end_tiles_early():
    """Once KEEP pairs of distance 0 are known, later rows can't hold a better one."""
    x = np.tile(np.random.default_rng(4).normal(size=(500, 4)), (12, 1))
    cfg = MotifConfig(window=8, low=2, high=2, K=4, L=4, r=8.0)
    kernel = search.Kernel(x, cfg, lsh.Projections(8, 4, 4, 8.0, 7))
    seen = []
    cell = search.tiles.Cell
    search.tiles.Cell = lambda *a: seen.append(len(a[0])) or cell(*a)
    try:
        found, compared = kernel.search_tiles(kernel.keys(0, 2), [2], [])
    finally:
        search.tiles.Cell = cell
    a, b = found[2]
    assert list(zip(a.tolist(), b.tolist())) == sorted((p, q) for p in range(40) for q in range(p + 500, kernel.n, 500))[: search.KEEP]
    assert len(seen) == 2 and compared < 1_000_000  # of three blocks, all in the first row


def test_exact_search_takes_over_before_all_pairs_are_looked_at(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(2400, 3))
    points = spark.createDataFrame([("s", t, m, float(x[t, m])) for t in range(len(x)) for m in range(3)], "series_id string, t long, dim int, value double")
    looked = []
    monkeypatch.setattr(search, "_exactly", lambda *a: looked.append(a) or search._frame(spark, {}))
    cfg = MotifConfig(window=8, low=2, high=2, K=2, L=8, r=32.0)
    (result,) = search.anytime(points, cfg)  # none of the batch whose repetitions it replaces
    assert result.repetitions == 8 and len(looked) == 1
