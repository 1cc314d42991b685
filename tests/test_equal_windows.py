"""Sums over pairs of equal windows, which are compared once."""

import numpy as np
import pytest

from leitmotiv.operators import distance, tiles


@pytest.mark.parametrize("high", [None, 3])
@pytest.mark.parametrize("copies", [True, False])
def test_equal_windows_count_as_often_as_they_are_there(monkeypatch, high, copies):
    x = np.random.default_rng(4).normal(size=(1400, 3)).round(2)
    if copies:
        x = np.tile(x[:200], (7, 1))
    z = distance.normalised(np.lib.stride_tricks.sliding_window_view(x, 8, axis=0).transpose(1, 0, 2))
    t = np.arange(z.shape[1])
    compared, kernel = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: compared.append(k["out"].size) or kernel(*a, **k))
    for a, b in ((slice(0, 650), slice(660, 1390)), (slice(0, 700), slice(0, 700)), (slice(0, 700), slice(700, 1390))):
        compared.clear()
        cell = tiles.Cell(t[a], z[:, a], t[b], z[:, b], 8, double=True)
        found = tiles.summary(cell, high)
        i, j = np.nonzero(t[None, b] - t[a, None] > 8)
        dist = cell.exact(i, j)
        if high:
            dist = tiles.ranked(dist)[2][:, :high]
        assert found["pairs"].tolist() == [len(i)] * 3
        assert found["least"].tolist() == dist.min(0).tolist()
        assert found["most"] == pytest.approx(dist.max(0), abs=1e-6)
        assert found["total"] == pytest.approx(dist.sum(0), rel=1e-10)
        if b.start == 660:
            assert (sum(compared) < 0.2 * 3 * cell.a.size * cell.b.size) == copies
