"""Pairs met, counted in bits, and looked up one by one: against whole tiles."""

import numpy as np
import pytest

from leitmotiv.operators import distance, lsh, tiles


@pytest.mark.parametrize("n,gap", [(500, 0), (300, 100), (40, 0), (64, 5000)])
def test_met_in_bits_and_one_by_one(n, gap, monkeypatch):
    w, rng = 8, np.random.default_rng(n)

    def side(start):
        x = rng.normal(size=(n + w - 1, 5)).round(1)
        x[: n // 4] = 1.0
        return np.arange(start, start + n), distance.normalised(np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(1, 0, 2))

    a, za = side(0)
    b, zb = (a, za) if not gap else side(gap)
    cell = tiles.Cell(a, za, b, zb, w)
    buckets = lsh.Buckets(cell, lsh.Projections(w, 4, 4, 4.0, 7), (2, 4))
    for prefix in (2, 4):
        for least in (1, 2, 5):
            met = np.vstack([np.hstack([buckets.met(prefix, least, x, slice(0, n))]) for x in (slice(0, n),)])
            assert buckets.count_met(prefix, least) == met.sum()
            i, j = np.nonzero(b[None, :] - a[:, None] > w)
            assert buckets.met_one(prefix, least, i, j).tolist() == met[i, j].tolist()
    # Neither looks at pairs one tile after the other.
    monkeypatch.setattr(lsh.Buckets, "agree", None)
    assert buckets.count_met(2, 2) and cell.one is None
    lsh.only_met(lsh.Projections(w, 4, 4, 4.0, 7), 2, 2)(cell)
    assert cell.one(np.array([0]), np.array([n - 1])).shape == (1,)


def test_rows_are_numbered_alike_however_wide_their_codes_are():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 40):
        codes = rng.integers(-most, most, (300, 4))[rng.integers(0, 300, 900)]
        number = lsh._numbered(codes).astype(int)
        rows = np.unique(codes, axis=0, return_inverse=True)[1].ravel()
        assert len(set(zip(number.tolist(), rows.tolist()))) == len(set(rows.tolist())) == len(set(number.tolist()))
