"""Symbolic words of windows and axis-aligned random projection: how often two windows agree on d dimensions' words."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leitmotiv.functions.symbols import symbol


def segments(z: DataFrame, segment: int, source: str = "z") -> DataFrame:
    """Adds paa: the means of consecutive segments of a window (the last may be shorter)."""
    starts = F.sequence(F.lit(1), F.size(source), F.lit(segment))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return z.withColumn("paa", F.transform(starts, lambda s: mean(F.slice(source, s, segment))))


def words(z: DataFrame, segment: int, alphabet: int = 4, source: str = "z") -> DataFrame:
    """series_id, t, dim, word (array of symbols). source: z, or values to leave windows as they are."""
    return segments(z, segment, source).select("series_id", "t", "dim", F.transform("paa", lambda x: symbol(x, alphabet)).alias("word"))


def collision_counts(words: DataFrame, dims: int, d: int, window: int) -> DataFrame:
    """series_id, a, b, n: on how many choices of d dimensions all words of both windows are equal; b - a >= window.

    An equi-join on (choice, words); only pairs that collide have a row.
    """
    packed = words.groupBy("series_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("dim", "word"))).alias("w"))
    sets = F.array(*[F.struct(F.lit(k).alias("choice"), F.array(*[F.element_at("w", F.lit(m)) for m in c]).alias("key")) for k, c in enumerate(combinations(range(dims), d))])
    rows = packed.select("series_id", "t", F.explode(sets).alias("s")).select("series_id", "t", "s.choice", "s.key")
    left, right = rows.withColumnRenamed("t", "a"), rows.withColumnRenamed("t", "b")
    met = left.join(right, ["series_id", "choice", "key"]).where(F.col("b") - F.col("a") >= window)
    return met.groupBy("series_id", "a", "b").agg(F.count("*").alias("n"))


def promising(counts: DataFrame, least: int = 5) -> DataFrame:
    """The pairs of the highest counts, down to the count at which at least `least` pairs are in; all, if there are fewer."""
    levels = counts.groupBy("series_id", "n").agg(F.count("*").alias("pairs"))
    run = F.sum("pairs").over(Window.partitionBy("series_id").orderBy(F.col("n").desc()))
    cut = levels.withColumn("_run", run).groupBy("series_id").agg(F.coalesce(F.max(F.when(F.col("_run") >= least, F.col("n"))), F.min("n")).alias("_cut"))
    return counts.join(cut, "series_id").where(F.col("n") >= F.col("_cut")).drop("_cut")
