"""Symbols of the normal distribution for symbolic aggregation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def breakpoints(alphabet: int) -> list[float]:
    """The alphabet - 1 cuts that a standard normal falls between equally often, to 6 decimals."""
    return [round(NormalDist().inv_cdf(k / alphabet), 6) + 0.0 for k in range(1, alphabet)]


def symbol(x: Column, alphabet: int) -> Column:
    """How many breakpoints are at most x."""
    out = F.lit(0)
    for b in breakpoints(alphabet):
        out = out + F.when(x >= b, 1).otherwise(0)
    return out
