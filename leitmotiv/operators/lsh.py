"""Discretised random projections of windows, and candidate pairs by equal code prefixes.

A signature has K codes floor((a . z + b) / r); all dimensions share the projections. Tensored repetitions take the even codes from one of
ceil(sqrt L) left groups and the odd ones from a right group, so L repetitions need few projections. Candidates are an equi-join on
(dimension, repetition, prefix) with the exclusion zone as its residual condition, and a count of dimensions. Signatures go
through the join, the windows' values don't. Where prefixes are short and buckets hold much of a series, cells of chunks of points do the same without a
join (candidates_in_cells and what follows it).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leitmotiv.functions.random import gaussian, uniform
from leitmotiv.operators import tiles
from leitmotiv.operators.distance import cells, chunks, dealt, over_cells
from leitmotiv.operators.windows import ZERO_STD, chunked


class Projections:
    """a: projections x window, b: offsets; of(l): the rows of repetition l, code by code."""

    def __init__(self, window: int, K: int, L: int, r: float, seed: int, tensored: bool = True) -> None:
        if K % 2:
            raise ValueError("K must be even")
        self.K, self.L, self.r, self.side = K, L, r, math.isqrt(L - 1) + 1
        if tensored:
            tags = [(half, g, k) for half in (0, 1) for g in range(self.side) for k in range(K // 2)]
        else:
            tags = [(rep, c) for rep in range(L) for c in range(K)]
        self.a = np.array([[gaussian(seed, *tag, o) for o in range(window)] for tag in tags])
        self.b = np.array([uniform(seed, "b", *tag) * r for tag in tags])
        at = {tag: n for n, tag in enumerate(tags)}
        if tensored:
            self.rows = [[at[c % 2, rep // self.side if c % 2 == 0 else rep % self.side, c // 2] for c in range(K)] for rep in range(L)]
        else:
            self.rows = [[at[rep, c] for c in range(K)] for rep in range(L)]

    def of(self, rep: int) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.rows[rep]], self.b[self.rows[rep]]

    def codes(self, z: np.ndarray) -> np.ndarray:
        """windows x projections, of z: windows x window."""
        return np.floor((z @ self.a.T + self.b) / self.r).astype(np.int32)


def signatures(z: DataFrame, projections: Projections, reps: range | None = None) -> DataFrame:
    """series_id, t, dim, l, code (array<int>) of subsequences z(series_id, t, dim, z)."""
    reps = reps or range(projections.L)
    shared = z.sparkSession.sparkContext.broadcast(projections)  # as large as the configuration, not as the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        rows = np.array([p.rows[rep] for rep in reps])
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            codes = p.codes(np.asarray(b.column(3).flatten(), np.float64).reshape(n, -1))[:, rows]  # windows x repetitions x K
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n * len(rows) + 1, dtype=np.int32) * p.K), pa.array(codes.ravel()))
            again = pa.array(np.repeat(np.arange(n), len(rows)))
            yield pa.RecordBatch.from_pydict({
                "series_id": b.column(0).take(again), "t": b.column(1).take(again), "dim": b.column(2).take(again),
                "l": np.tile(np.array(list(reps), np.int32), n), "code": flat,
            })

    return z.select("series_id", "t", "dim", "z").mapInArrow(run, "series_id string, t bigint, dim int, l int, code array<int>")


def collisions(sig: DataFrame, prefix: int, exclusion: int) -> DataFrame:
    """series_id, dim, l, a, b: pairs of windows with equal prefixes, b - a > exclusion."""
    keyed = sig.select("series_id", "dim", "l", "t", F.slice("code", 1, prefix).alias("key"))
    left, right = keyed.withColumnRenamed("t", "a"), keyed.withColumnRenamed("t", "b")
    return left.join(right, ["series_id", "dim", "l", "key"]).where(F.col("b") - F.col("a") > exclusion).select("series_id", "dim", "l", "a", "b")


def candidates(sig: DataFrame, prefix: int, least_dims: int, exclusion: int) -> DataFrame:
    """series_id, l, a, b, n_dims: collisions in at least least_dims dimensions of one repetition."""
    return collisions(sig, prefix, exclusion).groupBy("series_id", "l", "a", "b").agg(F.count("*").alias("n_dims")).where(F.col("n_dims") >= least_dims)


class Buckets:
    """Of a cell's windows and each prefix length asked for: by repetition and dimension the number of the bucket, the same on both sides."""

    def __init__(self, cell: tiles.Cell, projections: Projections, prefixes: tuple[int, ...]) -> None:
        self.cell, n = cell, len(cell.a)
        rows = np.array(projections.rows)
        codes = [np.concatenate([projections.codes(za), projections.codes(zb)])[:, rows].astype(np.int64) for za, zb in zip(cell.za, cell.zb)]
        self.keys = {p: [[_numbered(c[:, rep, :p]) for c in codes] for rep in range(len(rows))] for p in prefixes}
        self.sides = {p: [[(k[:n], k[n:]) for k in dims] for dims in reps] for p, reps in self.keys.items()}

    def agree(self, prefix: int, rep: int, x: slice, y: slice) -> np.ndarray:
        """On how many dimensions the windows of a tile agree in one repetition; 0 inside the zone."""
        out = np.zeros((x.stop - x.start, y.stop - y.start), np.uint16)
        for a, b in self.sides[prefix][rep]:
            out += a[x, None] == b[None, y]
        if (counted := self.cell.counted(x, y)) is not True:
            out *= counted
        return out

    def met_one(self, prefix: int, least_dims: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """met() of single pairs, given their rows on both sides."""
        out = np.zeros(len(i), bool)
        for dims in self.sides[prefix]:
            out |= sum((a[i] == b[j]).astype(np.uint16) for a, b in dims) >= least_dims
        return out

    def count_met(self, prefix: int, least_dims: int) -> int:
        """How many pairs of the cell are met(). A bucket's windows b are a row of bits, so 64 pairs are looked at at once."""
        a, b = self.cell.a, self.cell.b
        words = np.arange(-(-len(b) // 64))
        met = np.zeros((len(a), len(words)), np.uint64)
        for dims in self.sides[prefix]:
            tables = [_bits(q, int(max(p.max(), q.max())) + 1) for p, q in dims]
            for k in range(0, len(a), tiles.ROWS):
                x = slice(k, k + tiles.ROWS)
                level = [np.zeros_like(met[x]) for _ in range(least_dims)]  # agree on 1, 2, ... dimensions at least
                for (p, _), table in zip(dims, tables):
                    hit = table[p[x]]
                    for m in range(least_dims - 1, 0, -1):
                        level[m] |= level[m - 1] & hit
                    level[0] |= hit
                met[x] |= level[-1]
        total = 0
        for k in range(0, len(a), tiles.ROWS):
            x = slice(k, k + tiles.ROWS)
            first = np.searchsorted(b, a[x] + self.cell.least, "right")[:, None]  # the b before are inside the zone
            if first.max() > 0:
                part = ~np.uint64(0) << (first % 64).astype(np.uint64)
                met[x] &= np.where(words > first // 64, ~np.uint64(0), np.where(words == first // 64, part, np.uint64(0)))
            total += int(np.bitwise_count(met[x]).sum(dtype=np.int64))
        return total

    def met(self, prefix: int, least_dims: int, x: slice, y: slice) -> np.ndarray:
        """Which pairs of a tile agree on least_dims dimensions in any repetition."""
        out = np.zeros((x.stop - x.start, y.stop - y.start), bool)
        for rep in range(len(self.sides[prefix])):
            out |= self.agree(prefix, rep, x, y) >= least_dims
        return out


def _numbered(codes: np.ndarray) -> np.ndarray:
    """The number of each row among the distinct ones."""
    low, high = (v.astype(object) for v in (codes.min(0), codes.max(0)))
    kinds = math.prod(high - low + 1)
    if kinds < 1 << 62:
        out = np.zeros(len(codes), np.int64)
        for c, least, most in zip(codes.T, low, high):
            out = out * (most - least + 1) + (c - least)
        if kinds <= 4 * len(codes) + 65_536:  # numbered by a table, without sorting
            seen = np.zeros(kinds, bool)
            seen[out] = True
            out = (np.cumsum(seen) - 1)[out]
        else:
            out = np.unique(out, return_inverse=True)[1]
    else:
        out = np.zeros(len(codes), np.int64)
        for c in codes.T:
            c = np.unique(c, return_inverse=True)[1]
            out = np.unique(out * (c.max() + 1) + c, return_inverse=True)[1]
    return out.astype(np.uint16 if len(out) < 1 << 16 else np.int64)


def _bits(keys: np.ndarray, kinds: int) -> np.ndarray:
    """For each key below kinds a row of bits, in words of 64, that says where keys has it."""
    out = np.zeros((kinds, -(-len(keys) // 64) * 8), np.uint8)
    for k in range(8):
        part = keys[k::8]
        out[part, np.arange(len(part))] |= np.uint8(1 << k)  # a byte occurs once
    return out.view("<u8")


#: The largest chunk where cells return pairs: what a cell returns at most, if all its windows share a bucket, is that squared.
PAIRS_LARGEST = 2048


def _pairs_of(cell: tiles.Cell, of: Callable[[slice, slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = [(cell.a[x][i], cell.b[y][j]) for x, y in cell.tiles() for i, j in [np.nonzero(of(x, y))]]
    return tuple(np.concatenate(v) for v in zip(*found))


def candidates_in_cells(points: DataFrame, window: int, projections: Projections, prefix: int, least_dims: int) -> DataFrame:
    """candidates() of short prefixes, straight from points: where buckets hold a large part of all windows, their join makes about as many rows a dimension as
    there are pairs, and each has to be shuffled to be counted. Here a cell makes its windows' codes and counts equal buckets tile by tile."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        buckets, out = Buckets(cell, projections, (prefix,)), {c: [] for c in ("l", "a", "b", "n_dims")}
        for x, y in cell.tiles():
            for rep in range(projections.L):
                n = buckets.agree(prefix, rep, x, y)
                p, q = np.nonzero(n >= least_dims)
                for c, v in (("l", np.full(len(p), rep, np.int32)), ("a", cell.a[x][p]), ("b", cell.b[y][q]), ("n_dims", n[p, q].astype(np.int64))):
                    out[c].append(v)
        return {c: np.concatenate(v) for c, v in out.items()}

    return over_cells(points, window, run, "l int, a bigint, b bigint, n_dims bigint", largest=PAIRS_LARGEST)


def unseen_in_cells(points: DataFrame, window: int, projections: Projections, prefix: int, before: int, least_dims: int) -> DataFrame:
    """series_id, a, b: the pairs that any repetition has as candidates at prefix and none at the longer one before, each once."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        buckets = Buckets(cell, projections, (prefix, before))
        a, b = _pairs_of(cell, lambda x, y: buckets.met(prefix, least_dims, x, y) & ~buckets.met(before, least_dims, x, y))
        return {"a": a, "b": b}

    return over_cells(points, window, run, "a bigint, b bigint", largest=PAIRS_LARGEST)


def pairs_met(points: DataFrame, window: int, projections: Projections, prefixes: tuple[int, ...], least_dims: int) -> DataFrame:
    """prefix, pairs: how many pairs are candidates in any repetition."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        buckets = Buckets(cell, projections, prefixes)
        return {"prefix": np.array(prefixes, np.int32), "pairs": np.array([buckets.count_met(p, least_dims) for p in prefixes])}

    return over_cells(points, window, run, "prefix int, pairs bigint").groupBy("prefix").agg(F.sum("pairs").alias("pairs"))


def dims_met(points: DataFrame, window: int, projections: Projections, prefix: int) -> DataFrame:
    """n_dims, pairs: over all repetitions, how many pairs agree on how many dimensions, from 1."""

    def run(cell: tiles.Cell, i: int, j: int) -> dict:
        buckets, dims = Buckets(cell, projections, (prefix,)), len(cell.za)
        n = sum(np.bincount(buckets.agree(prefix, rep, x, y).ravel(), minlength=dims + 1) for x, y in cell.tiles() for rep in range(projections.L))
        return {"n_dims": np.arange(1, dims + 1), "pairs": n[1:]}

    return over_cells(points, window, run, "n_dims bigint, pairs bigint").where("pairs > 0").groupBy("n_dims").agg(F.sum("pairs").alias("pairs"))


def only_met(projections: Projections, prefix: int, least_dims: int) -> Callable[[tiles.Cell], None]:
    """Limits a cell to the candidates of any repetition."""

    def limit(cell: tiles.Cell) -> None:
        buckets = Buckets(cell, projections, (prefix,))
        cell.only = lambda x, y: buckets.met(prefix, least_dims, x, y)
        cell.one = lambda i, j: buckets.met_one(prefix, least_dims, i, j)

    return limit


def bucket_sizes(sig: DataFrame, prefix: int) -> DataFrame:
    return sig.groupBy("series_id", "dim", "l", F.slice("code", 1, prefix).alias("key")).agg(F.count("*").alias("members"))


def bucket_pairs(sig: DataFrame, prefix: int) -> int:
    """How many pairs of windows share a bucket, in all dimensions and repetitions: the rows that a join on the buckets makes, at most."""
    return int(bucket_sizes(sig, prefix).agg(F.sum(F.col("members").cast("decimal(38,0)") * (F.col("members") - 1) / 2)).first()[0] or 0)


def unseen(now: DataFrame, before: DataFrame) -> DataFrame:
    """Candidates of a shorter prefix that were none at a longer one."""
    return now.join(before.select("series_id", "a", "b").distinct(), ["series_id", "a", "b"], "left_anti")


def pair_windows(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """pairs(series_id, a, b) with dist (array by dimension); z: packed windows (series_id, t, z)."""
    left = z.select("series_id", F.col("t").alias("a"), F.col("z").alias("za"))
    right = z.select("series_id", F.col("t").alias("b"), F.col("z").alias("zb"))
    squares = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    dist = F.zip_with("za", "zb", lambda x, y: F.sqrt(squares(x, y)))
    return pairs.join(left, ["series_id", "a"]).join(right, ["series_id", "b"]).select("series_id", "a", "b", dist.alias("dist"))


def bin_width(z: DataFrame, window: int, vectors: int = 50, seed: int = 7, exact: bool = True) -> DataFrame:
    """series_id, spread, r: (P95 - P5) of projections summed over dimensions, over 256, clamped to 4..32 and rounded up."""
    a = np.array([[[gaussian(seed, "r", v, m, o) * 10 for o in range(window)] for m in range(_dims(z))] for v in range(vectors)])
    shared = z.sparkSession.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, window)
                dot = np.einsum("no,nvo->nv", x, shared.value[:, np.asarray(b.column(1))].transpose(1, 0, 2))
                again = pa.array(np.repeat(np.arange(b.num_rows), vectors))
                yield pa.RecordBatch.from_pydict({"series_id": b.column(0).take(again), "t": b.column(3).take(again), "v": np.tile(np.arange(vectors, dtype=np.int32), b.num_rows), "x": dot.ravel()})

    dots = z.select("series_id", "dim", "z", "t").mapInArrow(run, "series_id string, t bigint, v int, x double").groupBy("series_id", "t", "v").agg(F.sum("x").alias("x"))
    p = lambda q: F.percentile("x", q) if exact else F.percentile_approx("x", q)
    spread = dots.groupBy("series_id").agg(F.abs(p(0.95) - p(0.05)).alias("spread"))
    return spread.withColumn("r", F.ceil(F.least(F.lit(32.0), F.greatest(F.lit(4.0), F.col("spread") / 256))).cast("int"))


def _dims(z: DataFrame) -> int:
    return z.agg(F.max("dim")).first()[0] + 1


def minhash_bands(sig: DataFrame, permutations: int, rows: int) -> DataFrame:
    """series_id, t, l, band, key: of a window's set of (dimension, code) tokens; equal keys of a band are candidates."""
    tokens = F.collect_set(F.xxhash64("dim", "code")).alias("_tokens")
    sets = sig.groupBy("series_id", "t", "l").agg(tokens)
    mins = F.array(*[F.array_min(F.transform("_tokens", lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(permutations)])
    out = sets.withColumn("_m", mins).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(permutations // rows - 1))))
    return out.select("series_id", "t", "l", "band", F.xxhash64(F.slice("_m", F.col("band") * rows + 1, rows)).alias("key"))


def minhash_candidates(bands: DataFrame, exclusion: int) -> DataFrame:
    """series_id, a, b: windows that share a band's key in a repetition, b - a > exclusion.

    A window's keys are compared in cells, where each pair is looked at once. A join on the keys makes a pair once for every key it shares, and all of them would be
    shuffled, and spilled, to be made distinct.
    """
    key = F.dense_rank().over(Window.orderBy("l", "band")) - 1
    kinds = bands.select("l", "band").distinct().withColumn("dim", key.cast("int"))  # one row a repetition and band
    keyed = bands.join(F.broadcast(kinds), ["l", "band"]).select("series_id", "t", "dim", F.col("key").alias("value"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        series, i, j = (x.as_py() for x in key)
        sides = {table["chunk"][row].as_py(): [np.asarray(table[c][row].values) for c in ("ts", "values")] for row in range(table.num_rows)}
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if i in sides and j in sides:
            (a, x), (b, y) = sides[i], sides[j]
            x, y = x.reshape(len(a), -1), y.reshape(len(b), -1)
            for m in range(0, len(a), tiles.ROWS):
                at = slice(m, m + tiles.ROWS)
                met = np.zeros((len(a[at]), len(b)), bool)
                for k in range(x.shape[1]):
                    met |= x[at, k, None] == y[None, :, k]
                met &= b[None, :] - a[at, None] > exclusion
                p, q = np.nonzero(met)
                found.append((a[at][p], b[q]))
        a, b = (np.concatenate(v) for v in zip(*found))
        return pa.table({"series_id": pa.array([series] * len(a), pa.string()), "a": a, "b": b})

    return dealt(cells(chunks(keyed, 1, PAIRS_LARGEST))).groupBy("series_id", "i", "j").applyInArrow(run, "series_id string, a bigint, b bigint")


def _gapless(t: np.ndarray, values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the full windows in points sorted by t, and their values."""
    if len(t) < window:
        return t[:0], values[:0].reshape(0, window)
    full = np.flatnonzero(t[window - 1 :] - t[: len(t) - window + 1] == window - 1)
    return t[full], np.lib.stride_tricks.sliding_window_view(values, window)[full]


def _normalised(v: np.ndarray) -> np.ndarray:
    std = v.std(1, keepdims=True)
    return (v - v.mean(1, keepdims=True)) / np.where(std == 0, ZERO_STD, std)


def point_signatures(points: DataFrame, window: int, projections: Projections, reps: range | None = None, chunk: int = 16_384) -> DataFrame:
    """signatures() straight from points: the windows of a chunk are made and hashed in its task, and never shuffled or written."""
    reps = reps or range(projections.L)
    shared = points.sparkSession.sparkContext.broadcast(projections)  # as large as the configuration, not as the data

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        p, (series, dim, c) = shared.value, (k.as_py() for k in key)
        table = table.sort_by("t")
        starts, values = _gapless(np.asarray(table["t"]), np.asarray(table["value"], np.float64), window)
        own = starts // chunk == c
        starts, values = starts[own], values[own]
        rows = np.array([p.rows[rep] for rep in reps])
        step = max(1, 500_000 // rows.size)
        for k in range(0, len(starts), step):
            codes = p.codes(_normalised(values[k : k + step]))[:, rows]
            m = len(codes)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(m * len(rows) + 1, dtype=np.int32) * p.K), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_pydict({
                "series_id": pa.array([series] * (m * len(rows)), pa.string()), "t": np.repeat(starts[k : k + step], len(rows)),
                "dim": np.full(m * len(rows), dim, np.int32), "l": np.tile(np.array(list(reps), np.int32), m), "code": flat,
            })

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        kinds = pa.schema([("series_id", pa.string()), ("t", pa.int64()), ("dim", pa.int32()), ("l", pa.int32()), ("code", pa.list_(pa.int32()))])
        return pa.Table.from_batches([b.cast(kinds) for b in run(key, table)], kinds)

    parts = chunked(points, window - 1, chunk=chunk).drop("_own")
    return parts.groupBy("series_id", "dim", "_chunk").applyInArrow(whole, "series_id string, t bigint, dim int, l int, code array<int>")


def windows_at(points: DataFrame, starts: DataFrame, window: int, chunk: int = 16_384) -> DataFrame:
    """series_id, t, z (array of arrays, by dimension): the windows at starts(series_id, t), where all dimensions have them."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[int, list] = {int(t): [] for t in np.sort(np.asarray(right["t"]))}
        dims = np.asarray(left["dim"])
        left_t, left_v = np.asarray(left["t"]), np.asarray(left["value"], np.float64)
        for m in np.unique(dims):
            at = np.flatnonzero(dims == m)
            at = at[np.argsort(left_t[at])]
            starts_of, values = _gapless(left_t[at], left_v[at], window)
            wanted = np.flatnonzero(np.isin(starts_of, np.fromiter(out, np.int64, len(out))))
            for t, z in zip(starts_of[wanted].tolist(), _normalised(values[wanted])):
                out[t].append(z.tolist())
        full = len(np.unique(dims))
        rows = [(t, z) for t, z in out.items() if z and len(z) == full]
        return pa.table({
            "series_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "t": pa.array([r[0] for r in rows], pa.int64()),
            "z": pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.float64()))),
        })

    parts = chunked(points, window - 1, chunk=chunk).drop("_own").groupBy("series_id", "_chunk")
    asked = starts.select("series_id", "t").distinct().withColumn("_chunk", F.floor(F.col("t") / chunk).cast("bigint")).groupBy("series_id", "_chunk")
    return parts.cogroup(asked).applyInArrow(run, "series_id string, t bigint, z array<array<double>>")
