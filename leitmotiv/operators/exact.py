"""Exact motifs and matrix profiles: all pairs, compared in cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leitmotiv.functions.written import written
from leitmotiv.operators import tiles
from leitmotiv.operators.distance import lists, over_cells
from leitmotiv.operators.topk import greedy, top


MOTIF = "d int, a bigint, b bigint, distance double, dims array<int>, dim_dists array<double>"


def best_pairs(points: DataFrame, window: int, low: int, high: int, keep: int, exclusion: int | None = None, only: Callable[[tiles.Cell], None] | None = None) -> DataFrame:
    """Of every series and d: each cell's `keep` best pairs; so at least the `keep` best of all. only: limits a cell to the pairs that count."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        if only:
            only(cell)
        found = tiles.best(cell, range(low, high + 1), keep)
        flat = {c: np.concatenate([f[c] for f in found.values()]) for c in ("a", "b", "distance")}
        nested = {c: pa.concat_arrays([lists(f[c]) for f in found.values()]) for c in ("dims", "dim_dists")}
        return {"d": np.repeat(np.array(list(found), np.int32), [len(f["a"]) for f in found.values()])} | flat | nested

    return over_cells(points, window, run, MOTIF, exclusion)


def exact_motifs(points: DataFrame, window: int, low: int, high: int, k: int = 1, keep: int = 1000, exclusion: int | None = None, only: Callable[[tiles.Cell], None] | None = None) -> DataFrame:
    """series_id, d, rank, a, b, distance, dims, dim_dists: for each d the k best pairs that don't overlap.

    The greedy choice sees the `keep` best pairs. Where these hold fewer than k and weren't all there are, it is made again over four
    times as many, so the result is the one over all pairs. Each list is written, so that a lost executor doesn't repeat the search.
    """
    while True:
        pairs = written(top(best_pairs(points, window, low, high, keep, exclusion, only), keep, "series_id", "d"), "best")
        chosen = greedy(pairs, k, window, "series_id", "d")
        seen = pairs.groupBy("series_id", "d").count()
        short = seen.join(chosen.groupBy("series_id", "d").agg(F.count("*").alias("n")), ["series_id", "d"]).where((F.col("n") < k) & (F.col("count") >= keep))
        if k == 1 or short.isEmpty():
            return chosen
        keep *= 4


def matrix_profile(points: DataFrame, window: int, low: int, high: int, exclusion: int | None = None) -> DataFrame:
    """series_id, d, t, distance, neighbour: each window's nearest other outside the exclusion zone (ties: the smaller t)."""

    found = nearest_others(points, window, range(low, high + 1), "ab", exclusion)
    return found.drop("later")


def nearest_others(points: DataFrame, window: int, ds: range, sides: str, exclusion: int | None = None) -> DataFrame:
    """series_id, d, t, distance, neighbour, later: of each window the nearest other on the sides asked for, as an earlier (a) or a later (b) window of a
    pair, and how many windows are later.

    A cell returns one row for each of its chunks and d, with its windows' nearest in arrays, which are then merged by chunk.
    """
    schema = "d int, chunk bigint, t array<bigint>, distance array<double>, neighbour array<bigint>, later array<bigint>"
    kinds = {"t": pa.int64(), "distance": pa.float64(), "neighbour": pa.int64(), "later": pa.int64()}

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        out: dict[str, list] = {c: [] for c in ("d", "chunk", *kinds)}
        for side, own in tiles.nearest(cell, ds, sides).items():
            t = cell.a if side == "a" else cell.b
            later = len(cell.b) - np.searchsorted(cell.b, cell.a + cell.least, "right") if side == "a" else np.zeros(len(t), np.int64)
            for k, d in enumerate(ds):
                for c, v in (("d", d), ("chunk", i if side == "a" else j), ("t", t), ("distance", own.distance[k]), ("neighbour", own.other[k]), ("later", later)):
                    out[c].append(v)
        return {c: pa.array(v, pa.list_(kinds[c]) if c in kinds else pa.int32() if c == "d" else pa.int64()) for c, v in out.items()}

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        arrays = lambda c: (np.asarray(x.values) for x in table[c])
        t, later = np.asarray(table["t"][0].values), sum(arrays("later"))
        distance, neighbour = np.full(len(t), np.inf), np.zeros(len(t), np.int64)
        for far, other in zip(arrays("distance"), arrays("neighbour")):
            better = (far < distance) | ((far == distance) & (other < neighbour))
            distance, neighbour = np.where(better, far, distance), np.where(better, other, neighbour)
        has = np.isfinite(distance)
        n = int(has.sum())
        return pa.table({
            "series_id": pa.array([key[0].as_py()] * n, pa.string()), "d": np.full(n, key[1].as_py(), np.int32), "t": t[has], "distance": distance[has],
            "neighbour": neighbour[has], "later": later[has],
        })

    found = over_cells(points, window, run, schema, exclusion)
    return found.groupBy("series_id", "d", "chunk").applyInArrow(merge, "series_id string, d int, t bigint, distance double, neighbour bigint, later bigint")


def _over(x: Column, y: Column) -> Column:
    """x / y as floating point has it: past a minimum of 0, which exact copies have, infinite or, for 0, not a number."""
    return F.when(y != 0, F.try_divide(x, y)).when(x == 0, F.lit(float("nan"))).when(y == 0, F.lit(float("inf")))


def relative_contrast(profile: DataFrame) -> DataFrame:
    """series_id, d, contrast: the profile's mean over its minimum."""
    return profile.groupBy("series_id", "d").agg(_over(F.avg("distance"), F.min("distance")).alias("contrast"))


def profile_contrast(profile: DataFrame) -> DataFrame:
    """series_id, d, contrast: the nearest-neighbour distance of the most isolated window over that of the best pair."""
    return profile.groupBy("series_id", "d").agg(_over(F.max("distance"), F.min("distance")).alias("contrast"), F.max_by("t", F.struct("distance", -F.col("t"))).alias("discord"), F.min_by("t", F.struct("distance", "t")).alias("motif"))


def occurrences(z: DataFrame, motifs: DataFrame, window: int, most: float = 2.0) -> DataFrame:
    """series_id, rank, t, distance: windows within `most` of a motif's first window on its dimensions, closest first, without overlap
    among each other or with the motif's own two windows. z: subsequences; motifs: rank, a, b, dims of each series (few rows)."""
    m = motifs.select("series_id", "rank", "a", "b", F.explode("dims").alias("dim"))
    base = m.join(z.select("series_id", F.col("t").alias("a"), "dim", F.col("z").alias("zm")), ["series_id", "a", "dim"])
    near = z.join(base, ["series_id", "dim"]).where((F.abs(F.col("t") - F.col("a")) >= window) & (F.abs(F.col("t") - F.col("b")) >= window))
    dist = F.sqrt(F.aggregate(F.zip_with("z", "zm", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    found = near.groupBy("series_id", "rank", "t").agg(F.sum(dist).alias("distance")).where(F.col("distance") < most)

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        t, far = np.asarray(table["t"]), np.asarray(table["distance"])
        taken: dict[int, int] = {}  # by t // window, which has one at most
        kept = []
        for k in np.lexsort((t, far)).tolist():
            at = int(t[k])
            own = at // window
            if all(abs(at - taken[o]) >= window for o in (own - 1, own, own + 1) if o in taken):
                taken[own] = at
                kept.append(k)
        return table.select(["series_id", "rank", "t", "distance"]).take(pa.array(kept, pa.int64()))

    kind = dict(found.dtypes)["rank"]
    return found.groupBy("series_id", "rank").applyInArrow(choose, f"series_id string, rank {kind}, t bigint, distance double")


def highlight(points: DataFrame, motifs: DataFrame, window: int) -> DataFrame:
    """series_id, rank, side (a or b), t, dim, value: the points under each motif's two windows on its dimensions."""
    spans = motifs.select("series_id", "rank", F.explode("dims").alias("dim"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("at")), F.struct(F.lit("b").alias("side"), F.col("b").alias("at")))).alias("s"))
    at = spans.select("series_id", "rank", "dim", "s.side", F.explode(F.sequence("s.at", F.col("s.at") + window - 1)).alias("t"))
    return points.join(F.broadcast(at), ["series_id", "dim", "t"]).select("series_id", "rank", "side", "t", "dim", "value")
