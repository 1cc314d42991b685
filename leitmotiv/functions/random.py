"""Counter-based random numbers: md5 of a tag, so that Spark, Python and other SQL engines draw the same ones."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def bits(*tag: object) -> int:
    return int(hashlib.md5("|".join(map(str, tag)).encode()).hexdigest()[:8], 16)


def uniform(*tag: object) -> float:
    """In [0, 1)."""
    return bits(*tag) / TWO32


def gaussian(*tag: object) -> float:
    """Box-Muller over the tag's draws 1 and 2."""
    return math.sqrt(-2 * math.log((bits(*tag, 1) + 1) / TWO32)) * math.cos(2 * math.pi * bits(*tag, 2) / TWO32)


def bits_col(*tag: Column | object) -> Column:
    parts = [t.cast("string") if isinstance(t, Column) else F.lit(str(t)) for t in tag]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform_col(*tag: Column | object) -> Column:
    return bits_col(*tag) / F.lit(float(TWO32))


def gaussian_col(*tag: Column | object) -> Column:
    u = (bits_col(*tag, 1) + 1) / F.lit(float(TWO32))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * bits_col(*tag, 2) / F.lit(float(TWO32)))
