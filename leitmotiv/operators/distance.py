"""Z-normalised Euclidean distances between windows, and the choice of the best dimensions of each pair.

Points are packed in chunks of consecutive t, each with a halo of the next window - 1, and every pair of chunks is one group, a cell. So an
all-pairs comparison shuffles points, not windows: with n points, D dimensions and chunks of B, (1 + window / B) * n * D * 8 bytes for each of the n / B
chunks. The cell makes its windows and compares them tile by tile (tiles.py), and returns what was found, not its pairs, unless these are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leitmotiv.operators import tiles
from leitmotiv.operators.windows import ZERO_STD

#: A tile's side, and a chunk's largest: long series have fewer and larger cells, so that neither the shuffle nor what cells return is in proportion
#: to the number of tiles. A series has about SIDE chunks until they reach LARGEST.
TILE, LARGEST, SIDE = 256, 8192, 32


def pack(z: DataFrame) -> DataFrame:
    """series_id, t, z (array of arrays, by dimension)."""
    rows = z.groupBy("series_id", "t").agg(F.sort_array(F.collect_list(F.struct("dim", "z"))).alias("_d"))
    return rows.select("series_id", "t", F.transform("_d", lambda x: x["z"]).alias("z"))


def chunks(points: DataFrame, window: int, largest: int = LARGEST) -> DataFrame:
    """series_id, chunk, size, first and last (chunks of the series), ts, values (by t, then dimension) of the t that all dimensions of the series have."""
    wide = points.where("value is not null").groupBy("series_id", "t").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_d"))
    span = points.groupBy("series_id").agg(F.min("t").alias("_low"), F.max("t").alias("_high"), F.count_distinct("dim").alias("_dims"))
    tiles = F.ceil((F.col("_high") - F.col("_low") + 1) / (SIDE * TILE))
    size = F.greatest(F.lit(TILE), F.least(F.lit(largest), tiles * TILE)).cast("bigint")
    of = lambda t: F.floor(t / F.col("size")).cast("bigint")
    span = span.withColumn("size", size).select("series_id", "size", "_dims", of(F.col("_low")).alias("first"), of(F.col("_high")).alias("last"))
    wide = wide.join(span, "series_id").where(F.size("_d") == F.col("_dims"))
    reach = F.sequence(F.greatest("first", of(F.col("t") - (window - 1))), of(F.col("t")))
    rows = wide.select("series_id", "size", "first", "last", F.explode(reach).alias("chunk"), F.struct(F.col("t").cast("bigint").alias("t"), F.transform("_d", lambda x: x["value"]).alias("v")).alias("_p"))
    rows = rows.groupBy("series_id", "chunk", "size", "first", "last").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return rows.select("series_id", "chunk", "size", "first", "last", F.transform("_p", lambda p: p["t"]).alias("ts"), F.flatten(F.transform("_p", lambda p: p["v"])).alias("values"))


def cells(packed: DataFrame) -> DataFrame:
    """Each chunk once for every pair of chunks (i <= j) that it is in."""
    out = packed.withColumn("_o", F.explode(F.sequence("first", "last")))
    return out.select("series_id", F.least("chunk", "_o").alias("i"), F.greatest("chunk", "_o").alias("j"), "chunk", "size", "ts", "values")


def dealt(rows: DataFrame) -> DataFrame:
    """Cells over as many tasks as there is room for: they are few bytes and much work, so their number of partitions is given, which Spark then keeps."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "series_id", "i", "j")


def normalised(x: np.ndarray) -> np.ndarray:
    """z of windows (the last axis), with mean and deviation summed in the order of windows.subsequences, and its guard for a deviation of 0."""
    mean, average, squares = np.zeros(x.shape[:-1]), np.zeros(x.shape[:-1]), np.zeros(x.shape[:-1])
    for n in range(x.shape[-1]):
        v = x[..., n]
        mean += v
        delta = v - average
        average += delta / (n + 1)
        squares += delta * (v - average)
    std = np.sqrt(squares / x.shape[-1])
    return (x - (mean / x.shape[-1])[..., None]) / np.where(std == 0, ZERO_STD, std)[..., None]


def _windows(table: pa.Table, row: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of a chunk's own windows, which have no gap, and their z: dimension, window, offset."""
    t, v = (np.asarray(table[c][row].values) for c in ("ts", "values"))
    chunk, size = table["chunk"][row].as_py(), table["size"][row].as_py()
    if len(t) < window:
        return t[:0], np.zeros((1, 0, window))
    own = np.flatnonzero((t[window - 1 :] - t[: len(t) - window + 1] == window - 1) & (t[: len(t) - window + 1] < (chunk + 1) * size))
    return t[own], normalised(sliding_window_view(v.reshape(len(t), -1).T, window, axis=1)[:, own])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one dimension: all squared distances of rows of a and b, summed in the order of the offsets."""
    if a.shape[1] <= 16:
        out = np.zeros((len(a), len(b)))
        for o in range(a.shape[1]):
            diff = a[:, o, None] - b[None, :, o]
            out += diff * diff
        return out
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    near = np.argwhere(out < 1e-4)  # the difference of large numbers is not exact enough there
    for i, j in near:
        out[i, j] = ((a[i] - b[j]) ** 2).sum()
    return np.maximum(out, 0)


def over_cells(points: DataFrame, window: int, run: Callable[[tiles.Cell, int, int], dict], schema: str, exclusion: int | None = None, largest: int = LARGEST, double: bool = False) -> DataFrame:
    """run(cell, i, j) of each two chunks with a pair b - a > exclusion (the window, unless given). Its columns are schema's but for series_id."""
    least = window if exclusion is None else exclusion

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        series, i, j = (x.as_py() for x in key)
        sides = {table["chunk"][row].as_py(): _windows(table, row, window) for row in range(table.num_rows)}
        found = _empty(schema)
        (a, za), (b, zb) = (sides.get(x, (np.zeros(0, np.int64), None)) for x in (i, j))
        if len(a) and len(b) and b[-1] - a[0] > least:
            found = run(tiles.Cell(a, za, b, zb, least, double), i, j)
        columns = {c: found[c] for c in _empty(schema)}
        return pa.table({"series_id": pa.array([series] * len(next(iter(columns.values()))), pa.string())} | columns)

    return dealt(cells(chunks(points, window, largest))).groupBy("series_id", "i", "j").applyInArrow(compare, f"series_id string, {schema}")


def lists(a: np.ndarray) -> pa.Array:
    """Each row a list."""
    kind = pa.int32() if a.dtype.kind == "i" else pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))


def _empty(schema: str) -> dict:
    kinds = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return {c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")}


def pair_distances(points: DataFrame, window: int, exclusion: int | None = None) -> DataFrame:
    """series_id, a, b, dist (array by dimension) of all pairs with b - a > exclusion (the window, unless given)."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        out = []
        for x, y in cell.tiles():
            p, q = np.nonzero(cell.b[None, y] - cell.a[x, None] > cell.least)
            dist = np.stack([np.sqrt(squared(za[x], zb[y]))[p, q] for za, zb in zip(cell.za, cell.zb)], 1)
            out.append((cell.a[x][p], cell.b[y][q], dist))
        a, b, dist = (np.concatenate(v) for v in zip(*out))
        return {"a": a, "b": b, "dist": lists(dist)}

    return over_cells(points, window, run, "a bigint, b bigint, dist array<double>", exclusion, largest=TILE)


def summary(points: DataFrame, window: int, high: int | None = None, exclusion: int | None = None) -> DataFrame:
    """series_id, n, pairs, least, most, mean of all pairs' distances: of each dimension n or, given high, of those summed over the n = 1 to high best
    dimensions. Pairs are counted in their cells and not made rows."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        found = tiles.summary(cell, high)
        return {"n": np.arange(len(found["pairs"]), dtype=np.int32) + (1 if high else 0)} | found

    found = over_cells(points, window, run, "n int, pairs bigint, least double, most double, total double", exclusion, double=True).where("pairs > 0")
    total = found.groupBy("series_id", "n").agg(F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))
    return total.select("series_id", "n", "pairs", "least", "most", (F.col("total") / F.col("pairs")).alias("mean"))


def ranked_dims(dist: Column) -> Column:
    """array<struct(dist, dim)> sorted by distance, then dimension."""
    return F.array_sort(F.transform(dist, lambda x, i: F.struct(x.alias("dist"), i.cast("int").alias("dim"))))


def best(ranked: Column, d: Column | int) -> dict[str, Column]:
    """The d best dimensions: their summed distance, numbers, and own distances."""
    top = F.slice(ranked, 1, d)
    return {
        "distance": F.aggregate(top, F.lit(0.0), lambda s, x: s + x["dist"]),
        "dims": F.transform(top, lambda x: x["dim"]),
        "dim_dists": F.transform(top, lambda x: x["dist"]),
    }


def subdimension(pairs: DataFrame, d: int) -> DataFrame:
    """Adds distance, dims, dim_dists on the d best of a pair's dimensions."""
    return pairs.withColumn("_r", ranked_dims(F.col("dist"))).withColumns(best(F.col("_r"), d)).drop("_r")


def profile_of_dims(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each d of low..high, all from one sorting: the running sum of the sorted distances."""
    rows = pairs.withColumn("_r", ranked_dims(F.col("dist"))).withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return rows.withColumns(best(F.col("_r"), F.col("d"))).drop("_r", "dist")
