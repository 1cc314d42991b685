"""Evaluation of search runs: recall, relative error, contrasts, parameter sweeps and scalability runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leitmotiv.config import MotifConfig
from leitmotiv.plans.search import find_motifs
from leitmotiv.sources.synthetic import planted, with_noise_dims

SWEEP = "dataset string, K int, L int, r double, delta double, window int, low int, high int, d int, rank int, a bigint, b bigint, distance double, comparisons bigint, seconds double"


def with_group(runs: DataFrame, by: tuple[str, ...], **aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's group: partial sums and a join, as a window would gather each group in one task."""
    keys = [F.col(c).alias(f"_k{n}") for n, c in enumerate(by)]
    groups = runs.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    on = [runs[c].eqNullSafe(groups[f"_k{n}"]) for n, c in enumerate(by)]
    return runs.join(groups, on).drop(*[f"_k{n}" for n in range(len(by))])


def recall(runs: DataFrame, *by: str, distance: str = "distance", within: float = 0.1) -> DataFrame:
    """by, recall: the share of runs whose distance is less than `within` above the group's least."""
    least = with_group(runs, by, _least=F.min(distance))
    return least.groupBy(*by).agg(F.avg((F.col(distance) - F.col("_least") < within).cast("double")).alias("recall"))


def relative_error(runs: DataFrame, *by: str, distance: str = "distance") -> DataFrame:
    """by, mare: the mean of (distance - least) / least."""
    least = with_group(runs, by, _least=F.min(distance))
    return least.groupBy(*by).agg(F.avg((F.col(distance) - F.col("_least")) / F.col("_least")).alias("mare"))


def group_mean(runs: DataFrame, value: str, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"))


def max_normalised(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds normalised: value over its group's largest."""
    return with_group(runs, by, _most=F.max(value)).withColumn("normalised", F.col(value) / F.col("_most")).drop("_most")


def mean_interval(runs: DataFrame, value: str, *by: str, quantile: float = 1.96) -> DataFrame:
    """by, mean, std (sample), low, high: mean -+ quantile * std / sqrt(n)."""
    out = runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    half = quantile * F.col("std") / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def with_metrics(times: DataFrame, metrics: DataFrame, *on: str) -> DataFrame:
    return times.join(metrics, list(on), "left")


def sweep(points: DataFrame, base: MotifConfig, dataset: str = "s", **grid: Iterable) -> DataFrame:
    """A row for each motif of each combination of the grid's parameters (names of MotifConfig)."""
    rows = []
    for values in product(*grid.values()):
        cfg = replace(base, **dict(zip(grid, values)))
        got = find_motifs(points, cfg)
        rows += [
            (dataset, cfg.K, cfg.L, float(cfg.r), cfg.delta, cfg.window, cfg.low, cfg.high, m["d"], m["rank"], m["a"], m["b"], m["distance"], got.comparisons, got.seconds)
            for m in got.motifs.collect()
        ]
    return points.sparkSession.createDataFrame(rows, SWEEP)


def scalability(spark, lengths: Iterable[int], cfg: MotifConfig, dims: int = 5, sigma: float = 0.01) -> DataFrame:
    """A planted series of each length, searched."""
    out = None
    for n in lengths:
        at = (n // 10, n // 2)
        rows = sweep(planted(spark, n, dims, cfg.window, cfg.low, at, sigma).cache(), cfg, dataset=str(n), seed=[cfg.seed])
        out = rows if out is None else out.unionByName(rows)
    return out


def noise_stability(points: DataFrame, n: int, dims: int, cfg: MotifConfig, more: Iterable[int] = (4, 16, 32)) -> DataFrame:
    """more, stable: whether the best motif with so many noise dimensions added overlaps the one without."""
    spark, first = points.sparkSession, find_motifs(points, cfg).motifs.where("rank = 1").first()
    rows = []
    for m in more:
        found = find_motifs(with_noise_dims(points, n, dims, m), cfg).motifs.where("rank = 1").first()
        rows.append((m, bool(found and first and abs(found["a"] - first["a"]) < cfg.window and abs(found["b"] - first["b"]) < cfg.window)))
    return spark.createDataFrame(rows, "more int, stable boolean")
