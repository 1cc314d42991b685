"""Sliding windows over points(series_id, t, dim, value): statistics, z-normalised subsequences, imputation, smoothing.

A dimension of any length is cut into chunks of t, each with a halo of the next window - 1 points, so that a window
function never needs a whole dimension in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
ZERO_STD = 0.001


def chunked(points: DataFrame, ahead: int, behind: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Adds _chunk, repeating the points that the neighbours' windows reach into; _own: whether the point is the chunk's own."""
    own = F.floor(F.col("t") / chunk).cast("bigint")
    reach = F.sequence(F.floor((F.col("t") - ahead) / chunk).cast("bigint"), F.floor((F.col("t") + behind) / chunk).cast("bigint"))
    out = points.withColumn("_chunk", F.explode(reach))
    return out.withColumn("_own", F.col("_chunk") == own)


def _frame(first: int, last: int) -> Window:
    return Window.partitionBy("series_id", "dim", "_chunk").orderBy("t").rowsBetween(first, last)


def window_stats(points: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """series_id, t, dim, mean, std (population) of each full window of consecutive t."""
    over = _frame(0, window - 1)
    out = chunked(points, window - 1, chunk=chunk).select(
        "series_id", "t", "dim", "_own",
        F.avg("value").over(over).alias("mean"), F.stddev_pop("value").over(over).alias("std"),
        F.count("value").over(over).alias("n"), F.max("t").over(over).alias("last"),
    )
    return out.where((F.col("n") == window) & (F.col("last") == F.col("t") + window - 1) & F.col("_own")).drop("n", "last", "_own")


def subsequences(points: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """series_id, t, dim, mean, std, values (array), z (array): z-normalised with std 0.001 in place of 0."""
    over = _frame(0, window - 1)
    out = chunked(points, window - 1, chunk=chunk).select(
        "series_id", "t", "dim", "_own",
        F.collect_list("value").over(over).alias("values"), F.avg("value").over(over).alias("mean"), F.max("t").over(over).alias("last"),
    )
    out = out.where((F.size("values") == window) & (F.col("last") == F.col("t") + window - 1) & F.col("_own"))
    out = out.select("series_id", "t", "dim", "mean", deviation("values").alias("std"), "values")
    return out.withColumn("z", F.transform("values", lambda x: (x - F.col("mean")) / guarded(F.col("std"))))


def deviation(values: Column) -> Column:
    """The population's deviation by Welford's sums, each square from the differences to the mean before and after, as DuckDB has it: stddev_pop differs in
    the last bits, which decide a symbol where a segment's mean is at a breakpoint."""

    def add(s: Column, x: Column) -> Column:
        n, gap = s["n"] + 1.0, x - s["mean"]
        mean = s["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * gap).alias("squares"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, none, add, lambda s: F.sqrt(s["squares"] / s["n"]))


def guarded(std: Column) -> Column:
    return F.when(std == 0, ZERO_STD).otherwise(std)


def impute_mean(points: DataFrame) -> DataFrame:
    """Null and NaN values become the mean of the series' other values, over all dimensions."""
    clean = F.when(~F.isnan("value"), F.col("value"))
    means = points.groupBy("series_id").agg(F.avg(clean).alias("_mean"))
    return points.join(means, "series_id").withColumn("value", F.coalesce(clean, "_mean")).drop("_mean")


def jitter(points: DataFrame, sigma: float = 0.001, seed: int = 7) -> DataFrame:
    """Adds normal noise, the same for the same (series, dim, t) and seed."""
    from leitmotiv.functions.random import gaussian_col

    return points.withColumn("value", F.col("value") + sigma * gaussian_col(seed, F.col("series_id"), F.col("dim"), F.col("t")))


def moving_average(points: DataFrame, half: int, chunk: int = CHUNK) -> DataFrame:
    """The mean of the 2 * half + 1 points around each t that has them all; a first-order Savitzky-Golay filter inside the series."""
    over = _frame(-half, half)
    out = chunked(points, half, half, chunk).withColumn("_n", F.count("value").over(over)).withColumn("_mean", F.avg("value").over(over))
    return out.where((F.col("_n") == 2 * half + 1) & F.col("_own")).select("series_id", "t", "dim", F.col("_mean").alias("value"))


def savitzky_golay(points: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """First-order filter with any window: means inside, and at both ends the line fitted to the first or last window points.

    For an even window the fit's point lies half a step right of the window's middle, as the line is read at the later of its two middle points.
    """
    before = window // 2
    over = _frame(-before, window - 1 - before)
    base = chunked(points, window, window, chunk)
    x = F.col("t").cast("double")
    base = base.withColumns({
        "_n": F.count("value").over(over), "_y": F.avg("value").over(over), "_x": F.avg(x).over(over),
        "_xy": F.avg(x * F.col("value")).over(over), "_xx": F.avg(x * x).over(over),
    }).where("_own")
    slope = (F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_xx") - F.col("_x") * F.col("_x"))
    inner = base.where(F.col("_n") == window).withColumn("_slope", slope)
    ends = inner.groupBy("series_id", "dim").agg(
        F.min_by(F.struct("_x", "_y", "_slope"), "t").alias("first"), F.max_by(F.struct("_x", "_y", "_slope"), "t").alias("last"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    fit = lambda e: F.col(f"{e}._y") + F.col(f"{e}._slope") * (x - F.col(f"{e}._x"))
    out = points.join(ends, ["series_id", "dim"]).join(inner.select("series_id", "dim", "t", (F.col("_y") + F.col("_slope") * (x - F.col("_x"))).alias("_mid")), ["series_id", "dim", "t"], "left")
    value = F.coalesce("_mid", F.when(F.col("t") < F.col("lo"), fit("first")).otherwise(fit("last")))
    return out.select("series_id", "t", "dim", value.alias("value"))


def transpose(points: DataFrame) -> DataFrame:
    return points.select("series_id", F.col("dim").cast("bigint").alias("t"), F.col("t").cast("int").alias("dim"), "value")


def orient(points: DataFrame) -> DataFrame:
    """Transposes if there are more dimensions than times; costs one job that counts both."""
    n, dims = points.agg(F.countDistinct("t"), F.countDistinct("dim")).first()
    return transpose(points) if dims > n else points
