"""Parameters of a motif search and their checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MotifConfig:
    """window: length of a subsequence; low, high: on how many of the dimensions motifs are measured; k: how many motifs.

    may_end_exact: whether the exact search may take over once hashing has cost as much.

    K, L: codes of a signature and repetitions; r: bin width (0: estimated); delta: allowed probability of missing a motif.
    """

    window: int
    low: int
    high: int
    k: int = 1
    K: int = 8
    L: int = 200
    delta: float = 0.01
    r: float = 0
    seed: int = 7
    stop_rule: str = "matching"
    batch: int = 64
    may_end_exact: bool = True

    def check(self, n: int, dims: int) -> None:
        """ValueError for what no search can answer. Window n is allowed, though it has no pair."""
        if dims == 1:
            raise ValueError("a multidimensional series is needed")
        if self.low == 1:
            raise ValueError("motifs on one dimension need a one-dimensional method")
        if self.window > n:
            raise ValueError("the window is longer than the series")
        if self.low < 1 or self.low > self.high or self.high > dims:
            raise ValueError("dimensionalities: 1 < low <= high <= dimensions of the series")
        if self.k < 1 or self.L < 1 or self.K < 2 or self.K % 2 or not 0 < self.delta < 1 or self.r < 0 or self.window < 2:
            raise ValueError("k and L from 1, K even, delta between 0 and 1, r from 0, window from 2")
        if self.stop_rule not in ("matching", "product"):
            raise ValueError("stop_rule: matching or product")
