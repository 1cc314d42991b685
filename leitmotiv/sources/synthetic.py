"""Series with a known answer, from counter-based random numbers: the same in any engine and at any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leitmotiv.functions.random import gaussian_col, uniform_col


def _grid(spark: SparkSession, n: int, dims: range) -> DataFrame:
    return spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.explode(F.sequence(F.lit(dims.start), F.lit(dims.stop - 1))).alias("dim"))


def planted(spark: SparkSession, n: int, dims: int, window: int, d: int, at: tuple[int, int], sigma: float = 0.01, seed: int = 3) -> DataFrame:
    """Noise, and a full sine over the window in the first d dimensions at both places, which may not overlap."""
    if abs(at[0] - at[1]) < window or min(at) < 0 or max(at) + window > n or d > dims:
        raise ValueError("two places at least a window apart, inside the series")
    t = F.col("t")
    wave = F.lit(0.0)
    for p in at:
        wave = wave + F.when((F.col("dim") < d) & t.between(p, p + window - 1), F.sin(2 * math.pi * (t - p) / (window - 1))).otherwise(0.0)
    return _grid(spark, n, range(dims)).withColumn("value", sigma * gaussian_col(seed, F.col("dim"), t) + wave)


def random_walk(spark: SparkSession, n: int, dims: int, most: float = 5.0, seed: int = 3) -> DataFrame:
    """Sums of steps of random sign and uniform size up to most."""
    t, m = F.col("t"), F.col("dim")
    step = F.when(uniform_col(seed, "sign", m, t) < 0.5, -1.0).otherwise(1.0) * uniform_col(seed, "size", m, t) * most
    over = Window.partitionBy("series_id", "dim").orderBy("t")
    return _grid(spark, n, range(dims)).withColumn("value", F.sum(step).over(over))


def with_noise_dims(points: DataFrame, n: int, dims: int, more: int, sigma: float = 0.01, seed: int = 3) -> DataFrame:
    """points of `dims` dimensions and n times, and `more` dimensions of noise behind them."""
    noise = _grid(points.sparkSession, n, range(dims, dims + more))
    return points.unionByName(noise.withColumn("value", sigma * gaussian_col(seed, "noise", F.col("dim"), F.col("t"))))
