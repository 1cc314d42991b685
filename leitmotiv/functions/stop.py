"""Collision probability of a discretised random projection, and the probability that a search has missed a motif.

Two windows at distance x fall in one bin of width r with probability
    p(x) = 1 - 2 Phi(-r/x) - 2 x / (sqrt(2 pi) r) (1 - exp(-r^2 / (2 x^2))),  p(0) = 1
(Datar et al., 2004). With prefixes of K - i codes and j repetitions done at this length, of L:
    i = 0:  (1 - P^K)^j,    else  (1 - P^m)^j (1 - P^(m+1))^(L-j),  m = K - i.
"matching" takes P as the product over the motif's dimensions, as a candidate needs all of them in one repetition; "product" multiplies
the dimensions' own misses, which is smaller and so stops sooner.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def collision_probability(distance: float, r: float) -> float:
    if distance <= 0:
        return 1.0
    q = r / distance
    return max(0.0, 1 - 2 * normal_cdf(-q) - 2 / (math.sqrt(2 * math.pi) * q) * (1 - math.exp(-q * q / 2)))


def miss_probability(distances: Sequence[float], r: float, i: int, j: int, K: int, L: int, rule: str = "matching") -> float:
    p = [collision_probability(x, r) for x in distances]

    def missed(q: float) -> float:
        m = K - i
        return (1 - q**K) ** j if i == 0 else (1 - q**m) ** j * (1 - q ** (m + 1)) ** (L - j)

    return missed(math.prod(p)) if rule == "matching" else math.prod(map(missed, p))


def normal_cdf_col(x: Column) -> Column:
    """Phi by the polynomial of Abramowitz and Stegun 26.2.17 (error under 1e-7), as SQL has no erf."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x < 0, tail).otherwise(1 - tail)


def collision_probability_col(distance: Column, r: Column) -> Column:
    q = r / distance
    p = 1 - 2 * normal_cdf_col(-q) - 2 / (math.sqrt(2 * math.pi) * q) * (1 - F.exp(-q * q / 2))
    return F.when(distance <= 0, F.lit(1.0)).otherwise(p)


def miss_probability_col(p: Column, dims: int, i: Column, j: Column, K: int, L: int) -> Column:
    """miss_probability with rule "matching" for `dims` dimensions that each collide with probability p."""
    q = F.pow(p, F.lit(dims))
    shorter = F.pow(1 - F.pow(q, K - i), j) * F.pow(1 - F.pow(q, K - i + 1), L - j)
    return F.when(i == 0, F.pow(1 - F.pow(q, F.lit(K)), j)).otherwise(shorter)
