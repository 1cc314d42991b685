"""Motif searches: by hashing with early stop, by symbols, or exact.

A hashing search goes from the longest prefix to the shortest, and at each from batch to batch of repetitions, small ones first. After a batch
the best pairs so far are known, and it stops when the probability that it has missed a better k-th motif is at most delta. A series
without close pairs would go on to prefixes that compare everything many times over; so once the hashing has cost as much as the exact search
would, that takes over and misses nothing. The whole is then at most twice the cheaper of the two.

It has two physical plans. A series of at most RESIDENT values is sent to all tasks, each of which hashes and compares one repetition; its
size is checked first. A larger one stays a DataFrame: signatures meet in an equi-join, and only the candidates' windows are made and joined to the pairs.
"""

from __future__ import annotations

import math
import time
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leitmotiv.config import MotifConfig
from leitmotiv.functions.stop import miss_probability
from leitmotiv.functions.written import written
from leitmotiv.operators import lsh, sax, tiles
from leitmotiv.operators.distance import pack, profile_of_dims
from leitmotiv.operators.exact import exact_motifs
from leitmotiv.operators.topk import choose
from leitmotiv.operators.windows import ZERO_STD, impute_mean, jitter, orient, subsequences

RESIDENT = 8_000_000
KEEP = 200
PAIRS_AT_ONCE = 2_000_000
#: A repetition compares its candidates tile by tile if its buckets hold more than PAIRS_AT_ONCE pairs and one in so many of all; and windows of a block of tiles.
DENSE, BLOCK = 20, 4096
MOTIFS = "d int, rank int, a bigint, b bigint, distance double, dims array<int>, dim_dists array<double>"


@dataclass
class SearchResult:
    """motifs: rows of MOTIFS; comparisons: distances computed, with repeats; distinct: pairs compared at least once where known."""

    motifs: DataFrame
    comparisons: int
    hash_seconds: float
    seconds: float
    repetitions: int
    stopped_early: bool


def load_series(points: DataFrame) -> np.ndarray:
    """times x dimensions, of one gapless series. Its span is held against its points before anything of that size is made."""
    n, low, high, dims = points.agg(F.count("*"), F.min("t"), F.max("t"), F.max("dim")).first()
    if n < (high - low + 1) * (dims + 1):
        raise ValueError("the series has gaps; impute it first")
    t = points.select("t", "dim", "value").toArrow()
    at, dim, value = (np.asarray(t[c]) for c in ("t", "dim", "value"))
    at = at - at.min()
    x = np.full((at.max() + 1, dim.max() + 1), np.nan)
    x[at, dim] = value
    if np.isnan(x).any():
        raise ValueError("the series has gaps; impute it first")
    return x


class Kernel:
    """Hashes and compares the windows of a series in memory."""

    def __init__(self, x: np.ndarray, cfg: MotifConfig, projections: lsh.Projections) -> None:
        self.x, self.cfg, self.p = np.ascontiguousarray(x.T), cfg, projections
        w = cfg.window
        self.view = np.lib.stride_tricks.sliding_window_view(self.x, w, axis=1)
        self.n = self.view.shape[1]
        self.step = max(1, 4_000_000 // w)  # windows that are copied out at once
        self.mean, self.std = np.empty((2, len(self.x), self.n))
        for m in range(len(self.x)):
            for k in range(0, self.n, self.step):
                s = slice(k, k + self.step)
                v = self.view[m, s]
                self.mean[m, s] = v.mean(1)
                self.std[m, s] = v.std(1)
        self.std[self.std == 0] = ZERO_STD

    def keys(self, rep: int, prefix: int) -> np.ndarray:
        """windows x dimensions: one number for each code prefix."""
        a, b = (p[:prefix] for p in self.p.of(rep))
        out = np.zeros((self.n, len(self.x)), np.uint64)
        total = a.sum(1)
        for m in range(len(self.x)):
            for k in range(0, self.n, self.step):
                s = slice(k, k + self.step)
                dot = self.view[m, s] @ a.T
                code = np.floor(((dot - self.mean[m, s, None] * total) / self.std[m, s, None] + b) / self.p.r).astype(np.int64).view(np.uint64)
                for c in range(prefix):
                    out[s, m] = (out[s, m] ^ code[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    out[s, m] ^= out[s, m] >> np.uint64(29)
        return out

    def _equal_pairs(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of windows with equal keys outside the exclusion zone, in pieces of bounded size."""
        order = np.argsort(keys, kind="stable")  # within a key by t
        s = keys[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        sizes = np.diff(np.r_[starts, len(s)])
        many = sizes > 1
        last = np.repeat((starts + sizes)[many], sizes[many])
        position = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[many], sizes[many])]) if many.any() else np.zeros(0, np.int64)
        behind = last - position - 1
        at = 0
        while at < len(position):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(behind[at:]), PAIRS_AT_ONCE)) + at)
            reps = behind[at:stop]
            i = np.repeat(position[at:stop], reps)
            offset = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
            a, b = order[i], order[i + 1 + offset]
            ok = b - a > self.cfg.window
            yield a[ok], b[ok]
            at = stop

    def candidates(self, mixed: np.ndarray, least_dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose prefixes agree on at least least_dims dimensions, found on each choice of so many."""
        dims = mixed.shape[1]
        if math.comb(dims, least_dims) <= 256:
            for choice in combinations(range(dims), least_dims):
                key = np.zeros(self.n, np.uint64)
                for m in choice:
                    key = (key ^ mixed[:, m]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(31)
                yield from self._equal_pairs(key)
            return
        found = [a * self.n + b for m in range(dims) for a, b in self._equal_pairs(mixed[:, m])]
        if found:
            pairs, n = np.unique(np.concatenate(found), return_counts=True)
            pairs = pairs[n >= least_dims]
            yield pairs // self.n, pairs % self.n

    def held(self, mixed: np.ndarray, least_dims: int) -> float:
        """How many pairs the buckets hold that candidates would list, a pair once for each choice of dimensions it agrees on."""
        dims = mixed.shape[1]
        listed = math.comb(dims, least_dims) > 256
        held = 0
        for choice in [(m,) for m in range(dims)] if listed else combinations(range(dims), least_dims):
            key = np.zeros(self.n, np.uint64)
            for m in choice:
                key = (key ^ mixed[:, m]) * np.uint64(0xC2B2AE3D27D4EB4F)
            n = np.unique(key, return_counts=True)[1].astype(float)
            held += float((n * (n - 1) / 2).sum())
        return held

    def dense(self, mixed: np.ndarray, least_dims: int) -> bool:
        """Whether the buckets hold so many pairs that to list them costs more than to look at all pairs, in time or, where they are listed by dimension, in memory."""
        return self._dense(mixed, least_dims, self.held(mixed, least_dims))

    def _dense(self, mixed: np.ndarray, least_dims: int, held: float) -> bool:
        listed = math.comb(mixed.shape[1], least_dims) > 256
        return held > (10 * PAIRS_AT_ONCE if listed else max(PAIRS_AT_ONCE, admissible(self.n, 0) / DENSE))

    def search_tiles(self, mixed: np.ndarray, ds: list[int], taken: list[tuple[int, int]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
        """Of each d a and b of the KEEP best candidates that don't overlap the pairs taken, and how many candidates were seen.

        Blocks go by rows and each goes on with the best pairs so far: once these are full, a tile counts only if it may hold a better one, and after
        KEEP pairs of distance 0 no later row does.
        """
        numbers = [np.unique(k, return_inverse=True)[1] for k in mixed.T]
        numbers = [k.astype(np.uint16 if k.max() < 1 << 16 else np.int64) for k in numbers]
        at = np.arange(self.n)
        free = np.ones(self.n, bool)
        for q in taken:
            for y in q:
                free &= np.abs(at - y) >= self.cfg.window
        compared = 0
        found: dict[int, dict] | None = None
        step = max(256, min(BLOCK, 4_000_000 // (self.cfg.window * len(self.x))))
        z = lambda s: (self.view[:, s] - self.mean[:, s, None]) / self.std[:, s, None]
        for i in range(0, self.n, step):
            if found and all(len(own["a"]) == KEEP and own["distance"][-1] == 0 and own["a"][-1] < i for own in found.values()):
                break
            p = slice(i, min(i + step, self.n))
            rows = z(p)
            for j in range(i, self.n, step):
                q = slice(j, min(j + step, self.n))
                cell = tiles.Cell(at[p], rows, at[q], rows if i == j else z(q), self.cfg.window)

                def only(x: slice, y: slice) -> np.ndarray:
                    nonlocal compared
                    agree = np.zeros((x.stop - x.start, y.stop - y.start), np.uint16)
                    for k in numbers:
                        agree += k[p][x, None] == k[q][None, y]
                    met = (agree >= min(ds)) & free[p][x, None] & free[q][None, y] & cell.counted(x, y)
                    compared += int(np.count_nonzero(met))
                    return met

                def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    nonlocal compared
                    agree = np.zeros(len(x), np.uint16)
                    for k in numbers:
                        agree += k[p][x] == k[q][y]
                    met = (agree >= min(ds)) & free[p][x] & free[q][y]
                    compared += int(np.count_nonzero(met))
                    return met

                cell.only, cell.one = only, one
                found = tiles.best(cell, range(min(ds), max(ds) + 1), KEEP, found)
        return {d: (found[d]["a"], found[d]["b"]) for d in ds}, compared

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(self.x)))
        step = self.step
        for k in range(0, len(a), step):
            i, j = a[k : k + step], b[k : k + step]
            for m in range(len(self.x)):
                za = (self.view[m, i] - self.mean[m, i, None]) / self.std[m, i, None]
                zb = (self.view[m, j] - self.mean[m, j, None]) / self.std[m, j, None]
                za -= zb
                out[k : k + step, m] = np.sqrt(np.einsum("ij,ij->i", za, za))
        return out

    def search(self, rep: int, prefix: int, ds: list[int], taken: list[tuple[int, int]] = (), most: float = math.inf) -> tuple[list[dict], dict[int, tuple], int, float] | None:
        """Of each d the KEEP best candidates of one repetition that don't overlap the pairs taken; for each d of which some were
        left out, the last one kept, as (distance, a, b); how many distances; seconds of hashing. None if all pairs would be looked at as the
        buckets hold `most` or more."""
        began = time.perf_counter()
        mixed = self.keys(rep, prefix)
        hashed = time.perf_counter() - began
        best: dict[int, list] = {d: [] for d in ds}
        compared, left_out = 0, set()
        held = self.held(mixed, min(ds))
        if self._dense(mixed, min(ds), held):
            if held >= most:
                return None
            near, compared = self.search_tiles(mixed, ds, taken)
            for d, (a, b) in near.items():
                dist = self.distances(a, b)
                order, ranked, running = tiles.ranked(dist)
                best[d] = sorted((running[i, d - 1], int(a[i]), int(b[i]), order[i, :d].tolist(), ranked[i, :d].tolist()) for i in range(len(a)))
                if len(a) == KEEP:
                    left_out.add(d)
            return self._rows(best, left_out, compared, hashed)
        for a, b in self.candidates(mixed, min(ds)):
            for q in taken:
                free = np.all([np.abs(x - y) >= self.cfg.window for x in (a, b) for y in q], axis=0)
                a, b = a[free], b[free]
            if not len(a):
                continue
            pair = np.unique(a * self.n + b)
            a, b = pair // self.n, pair % self.n
            compared += len(a)
            dist = self.distances(a, b)
            order = np.argsort(dist, axis=1, kind="stable")
            ranked = np.take_along_axis(dist, order, 1)
            running = np.cumsum(ranked, axis=1)
            for d in ds:
                at = np.arange(len(a))
                if len(at) > KEEP:
                    far = running[:, d - 1]
                    at = np.flatnonzero(far <= np.partition(far, KEEP - 1)[KEEP - 1])
                    at = at[np.lexsort((b[at], a[at], far[at]))[:KEEP]]
                    left_out.add(d)
                best[d] += [(running[i, d - 1], int(a[i]), int(b[i]), order[i, :d].tolist(), ranked[i, :d].tolist()) for i in at]
                best[d] = sorted({x[:3]: x for x in best[d]}.values())
                if len(best[d]) > KEEP:
                    left_out.add(d)
                    best[d] = best[d][:KEEP]
        return self._rows(best, left_out, compared, hashed)

    @staticmethod
    def _rows(best: dict[int, list], left_out: set[int], compared: int, hashed: float) -> tuple[list[dict], dict[int, tuple], int, float]:
        rows = [{"d": d, "distance": x[0], "a": x[1], "b": x[2], "dims": x[3], "dim_dists": x[4]} for d in best for x in best[d]]
        return rows, {d: best[d][-1][:3] for d in left_out}, compared, hashed


ALL = (math.inf, 0, 0)


class Found:
    """The best candidates of one d over all repetitions so far, and how far each repetition's lists reach.

    A list holds a repetition's candidates that don't overlap some taken pairs, up to an end. So it also holds all up to there that don't overlap more pairs.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple, dict] = {}
        self.ends: dict[tuple[int, int], dict[frozenset, tuple]] = {}

    def add(self, run: tuple[int, int], taken: list[tuple[int, int]], rows: list[dict], end: tuple) -> None:
        self.rows.update({(r["distance"], r["a"], r["b"]): r for r in rows})
        self.ends.setdefault(run, {})[frozenset(taken)] = end

    def choose(self, k: int, window: int) -> tuple[list[dict], list[tuple[int, int]]]:
        """The best pairs that don't overlap, k at most, as far as the lists tell; and the repetitions to search again past these."""
        out: list[dict] = []
        for key, r in sorted(self.rows.items(), key=lambda x: x[0]):
            if len(out) == k:
                break
            if all(abs(r[x] - q[y]) >= window for q in out for x in "ab" for y in "ab"):
                if short := self._short(out, key):
                    return out, short
                out.append(r)
        return out, [] if len(out) == k else self._short(out, ALL)

    def _short(self, out: list[dict], key: tuple) -> list[tuple[int, int]]:
        taken = {(q["a"], q["b"]) for q in out}
        return [run for run, ends in self.ends.items() if max(end for over, end in ends.items() if over <= taken) < key]


def _frame(spark: SparkSession, chosen: dict[int, list[dict]]) -> DataFrame:
    rows = [(d, n + 1, m["a"], m["b"], float(m["distance"]), m["dims"], m["dim_dists"]) for d, found in sorted(chosen.items()) for n, m in enumerate(found)]
    return spark.createDataFrame(rows, MOTIFS)


def _finished(chosen: list[dict], cfg: MotifConfig, r: float, i: int, j: int) -> bool:
    return len(chosen) >= cfg.k and miss_probability(chosen[-1]["dim_dists"], r, i, j, cfg.K, cfg.L, cfg.stop_rule) <= cfg.delta


#: What a code of a window, and a candidate pair's distances, cost in units of a pair's distances in the exact search, which is one matrix
#: product a block (measured: 12 million pairs of 50 points on 5 dimensions in 0.4 s on 8 cores).
CODE_COST, CANDIDATE_COST = 10, 20


class Batches:
    """(i, repetitions): at each prefix length `first` repetitions, then up to twice as many as before, but no more than cfg.batch or than
    the exact search's cost has left at the last batch's rate."""

    def __init__(self, cfg: MotifConfig, n: int, first: int = 8) -> None:
        self.cfg, self.first, self.pairs = cfg, min(first, cfg.batch), admissible(n, cfg.window)
        self.codes, self.work, self.done = n * cfg.K * CODE_COST, 0, 0

    def __iter__(self) -> Iterator[tuple[int, range]]:
        for i in range(self.cfg.K):
            done, size = 0, self.first
            while done < self.cfg.L:
                reps = range(done, min(self.cfg.L, done + size))
                before = self.work
                yield i, reps
                rate = (self.work - before) / len(reps)
                done, size = done + len(reps), int(min(2 * size, self.cfg.batch, max(self.first, (self.pairs - self.work) / rate if self.cfg.may_end_exact else self.cfg.L)))

    def count(self, repetitions: int, compared: int) -> None:
        self.done = repetitions
        self.work = repetitions * self.codes + compared * CANDIDATE_COST

    def too_many(self, collisions: int) -> bool:
        """Whether to join so many pairs costs more than the exact search; one costs at least what a pair's distances do."""
        return self.cfg.may_end_exact and self.work + collisions >= self.pairs

    @property
    def spent(self) -> bool:
        return self.cfg.may_end_exact and self.work >= self.pairs


def admissible(n: int, window: int) -> int:
    """Pairs of windows with b - a > window in a series of n points."""
    m = max(0, n - window + 1 - window - 1)
    return m * (m + 1) // 2


def _exactly(points: DataFrame, cfg: MotifConfig) -> DataFrame:
    return exact_motifs(points, cfg.window, cfg.low, cfg.high, cfg.k).select("d", "rank", "a", "b", "distance", "dims", "dim_dists")


def _resident(points: DataFrame, cfg: MotifConfig) -> Iterator[SearchResult]:
    spark, began = points.sparkSession, time.perf_counter()
    origin = points.agg(F.min("t")).first()[0]
    x = load_series(points)
    cfg.check(*x.shape)
    r = cfg.r or estimate_bin_width(x, cfg.window, cfg.seed)
    projections = lsh.Projections(cfg.window, cfg.K, cfg.L, r, cfg.seed)
    shared, key = spark.sparkContext.broadcast((x, cfg, projections)), uuid.uuid4().hex
    open_ds, found = list(range(cfg.low, cfg.high + 1)), {d: Found() for d in range(cfg.low, cfg.high + 1)}
    compared, hashed, done = 0, 0.0, 0
    chosen: dict[int, list[dict]] = {}
    out = "rep int, d int, distance double, a bigint, b bigint, dims array<int>, dim_dists array<double>, last boolean, compared bigint, hashed double, dense boolean"
    if cfg.window >= len(x):
        yield SearchResult(_frame(spark, {}), 0, 0.0, time.perf_counter() - began, 0, False)
        return

    def look(reps: list[int], prefix: int, ds: list[int], taken: list[tuple[int, int]] = (), most: float = math.inf) -> bool:
        """Searches the repetitions, past the pairs taken; False if one of them is given up, as Kernel.search says."""
        nonlocal compared, hashed
        past = [(int(a - origin), int(b - origin)) for a, b in taken]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _kernel(key, shared)
            schema = pa.schema([("rep", pa.int32()), ("d", pa.int32()), ("distance", pa.float64()), ("a", pa.int64()), ("b", pa.int64()), ("dims", pa.list_(pa.int32())), ("dim_dists", pa.list_(pa.float64())), ("last", pa.bool_()), ("compared", pa.int64()), ("hashed", pa.float64()), ("dense", pa.bool_())])
            for b in batches:
                for rep in b.column(0).to_pylist():
                    none = {"d": None, "distance": None, "a": None, "b": None, "dims": None, "dim_dists": None, "last": False, "dense": False}
                    if (done := own.search(rep, prefix, ds, past, most)) is None:
                        yield pa.RecordBatch.from_pylist([none | {"rep": rep, "compared": 0, "hashed": 0.0, "dense": True}], schema)
                        continue
                    rows, ends, n, seconds = done
                    rows = [f | {"rep": rep, "last": (f["distance"], f["a"], f["b"]) == ends.get(f["d"]), "compared": 0, "hashed": 0.0, "dense": False} for f in rows]
                    yield pa.RecordBatch.from_pylist([*rows, none | {"rep": rep, "compared": n, "hashed": seconds}], schema)

        table = spark.createDataFrame([(r,) for r in reps], "id long").repartition(len(reps))
        got = table.mapInArrow(run, out).toArrow().to_pylist()  # KEEP rows a repetition and d
        rows: dict[tuple[int, int], list[dict]] = {(rep, d): [] for rep in reps for d in ds}
        for g in got:
            compared, hashed = compared + g["compared"], hashed + g["hashed"]
            if g["d"] is not None:
                rows[g["rep"], g["d"]].append({**g, "a": g["a"] + origin, "b": g["b"] + origin})
        if any(g["dense"] for g in got):
            return False
        for (rep, d), own in rows.items():
            end = next(((m["distance"], m["a"], m["b"]) for m in own if m["last"]), ALL)
            found[d].add((prefix, rep), taken, own, end)
        return True

    plan = Batches(cfg, len(x))
    for i, reps in plan:
        # One repetition that looks at all pairs costs what the exact search does.
        usual = look(list(reps), cfg.K - i, open_ds, most=plan.pairs / CANDIDATE_COST if cfg.may_end_exact else math.inf)
        done += len(reps)
        plan.count(done, compared)
        if not usual:
            yield SearchResult(_exactly(points, cfg), compared + plan.pairs, hashed, time.perf_counter() - began, done, True)
            return
        for d in open_ds:
            chosen[d], again = found[d].choose(cfg.k, cfg.window)
            while again:
                taken = [(m["a"], m["b"]) for m in chosen[d]]
                for prefix in sorted({p for p, _ in again}):
                    look([rep for p, rep in again if p == prefix], prefix, [d], taken)
                chosen[d], again = found[d].choose(cfg.k, cfg.window)
        open_ds = [d for d in open_ds if not _finished(chosen[d], cfg, r, i, reps.stop)]
        yield SearchResult(_frame(spark, chosen), compared, hashed, time.perf_counter() - began, done, not open_ds)
        if not open_ds:
            return
        if plan.spent:
            yield SearchResult(_exactly(points, cfg), compared + plan.pairs, hashed, time.perf_counter() - began, done, True)
            return


_kernels: dict[str, Kernel] = {}


def _kernel(key: str, shared: Broadcast) -> Kernel:
    """A worker's kernel of the search at hand; window statistics are computed once a worker."""
    if key not in _kernels:
        _kernels.clear()
        _kernels[key] = Kernel(*shared.value)
    return _kernels[key]


def _distributed_bin_width(points: DataFrame, cfg: MotifConfig, n: int, sample: int = 2000) -> int:
    """From some `sample` windows, chosen by a hash of their place; at least one."""
    share = max(1, n // sample)
    starts = points.where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0).select("series_id", "t")
    z = lsh.windows_at(points, starts, cfg.window).select("series_id", "t", F.posexplode("z").alias("dim", "z"))
    found = lsh.bin_width(written(z, "sample"), cfg.window, seed=cfg.seed).agg(F.max("r")).first()[0]
    return found or 4


def _distributed(points: DataFrame, cfg: MotifConfig) -> Iterator[SearchResult]:
    began = time.perf_counter()
    n, dims = points.agg(F.countDistinct("t"), F.countDistinct("dim")).first()
    cfg.check(n, dims)
    r = cfg.r or _distributed_bin_width(points, cfg, n)
    projections = lsh.Projections(cfg.window, cfg.K, cfg.L, r, cfg.seed)
    kept: DataFrame | None = None
    seen: DataFrame | None = None
    compared, done = 0, 0
    plan = Batches(cfg, n)
    for i, reps in plan:
        signatures = written(lsh.point_signatures(points, cfg.window, projections, reps), "signatures")
        # A flat stretch may share one bucket: before they are joined, the buckets' pairs must be fewer than the exact search has left.
        if plan.too_many(lsh.bucket_pairs(signatures, cfg.K - i)):
            yield SearchResult(_exactly(points, cfg), compared + plan.pairs, 0.0, time.perf_counter() - began, done, True)
            return
        pairs = lsh.candidates(signatures, cfg.K - i, cfg.low, cfg.window).select("series_id", "a", "b").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["series_id", "a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        compared += pairs.count()
        seen = pairs if seen is None else seen.unionByName(pairs)
        ends = pairs.select("series_id", F.col("a").alias("t")).unionByName(pairs.select("series_id", F.col("b").alias("t")))
        windows = written(lsh.windows_at(points, ends, cfg.window), "windows")
        found = profile_of_dims(lsh.pair_windows(pairs, windows), cfg.low, cfg.high)
        found = written(found, "measured")
        kept = found if kept is None else kept.unionByName(found)
        done += len(reps)
        plan.count(done, compared)
        motifs = choose(kept, cfg.k, cfg.window, "series_id", "d")
        chosen = {}
        for m in motifs.collect():  # k rows a dimensionality
            chosen.setdefault(m["d"], []).append(m)
        stop = all(_finished(sorted(chosen.get(d, []), key=lambda m: m["rank"]), cfg, r, i, reps.stop) for d in range(cfg.low, cfg.high + 1))
        yield SearchResult(motifs.select("d", "rank", "a", "b", "distance", "dims", "dim_dists"), compared, 0.0, time.perf_counter() - began, done, stop)
        if stop:
            return
        if plan.spent:
            yield SearchResult(_exactly(points, cfg), compared + plan.pairs, 0.0, time.perf_counter() - began, done, True)
            return


def anytime(points: DataFrame, cfg: MotifConfig, resident: int = RESIDENT) -> Iterator[SearchResult]:
    """The best motifs so far, after every batch of repetitions. points: one series; several are refused."""
    points = written(points, "series")  # else each of the looks at it, and the exact search, makes it from its source again
    first, last = points.agg(F.min("series_id"), F.max("series_id")).first()
    if first != last:
        raise ValueError(f"one series at a time, not {first!r} and {last!r}")
    small = points.limit(resident + 1).count() <= resident
    return (_resident if small else _distributed)(points, cfg)


def find_motifs(points: DataFrame, cfg: MotifConfig, resident: int = RESIDENT) -> SearchResult:
    """The k motifs for each dimensionality low..high, of one series."""
    for result in anytime(points, cfg, resident):
        last = result
    return last


def find_motifs_range(points: DataFrame, window: int, k: int, dims: tuple[int, int], **options) -> SearchResult:
    return find_motifs(points, MotifConfig(window=window, low=dims[0], high=dims[1], k=k, **options))


def discover(points: DataFrame, window: int, k: int, dims: tuple[int, int], noise: float = 0.0, **options) -> SearchResult:
    """The front door: orients the series, imputes missing values with a warning, adds noise if asked to, estimates the bin width, searches."""
    points = orient(points)
    if not points.where(F.col("value").isNull() | F.isnan("value")).isEmpty():
        warnings.warn("missing values become the series' mean", stacklevel=2)
        points = impute_mean(points)
    if noise:
        points = jitter(points, noise, options.get("seed", 7))
    return find_motifs_range(points, window, k, dims, **options)


def estimate_bin_width(x: np.ndarray, window: int, seed: int = 7, sample: int = 2000, vectors: int = 50) -> int:
    rng = np.random.default_rng(seed)
    n = len(x) - window + 1
    at = np.sort(rng.choice(n, min(n, sample), replace=False))
    a = rng.standard_normal((window, vectors, x.shape[1])) * 10
    total = np.zeros((len(at), vectors))
    for m in range(x.shape[1]):
        v = np.lib.stride_tricks.sliding_window_view(x[:, m], window)[at]
        std = v.std(1, keepdims=True)
        total += ((v - v.mean(1, keepdims=True)) / np.where(std == 0, ZERO_STD, std)) @ a[:, :, m]
    spread = abs(np.percentile(total, 95) - np.percentile(total, 5))
    return math.ceil(min(32.0, max(4.0, spread / 256)))


def find_motifs_sax(points: DataFrame, window: int, d: int, segment: int, alphabet: int = 4, k: int = 1, least: int = 5) -> DataFrame:
    """series_id, rank, a, b, distance, dims, dim_dists: the best of the pairs whose words agree most often."""
    z = subsequences(points, window)
    dims = points.agg(F.max("dim")).first()[0] + 1
    pairs = sax.promising(sax.collision_counts(sax.words(z, segment, alphabet), dims, d, window), least)
    measured = profile_of_dims(lsh.pair_windows(pairs.select("series_id", "a", "b"), pack(z)), d, d)
    return choose(written(measured, "measured"), k, window, "series_id").drop("d")


def find_motifs_exact(points: DataFrame, window: int, k: int, dims: tuple[int, int]) -> DataFrame:
    return exact_motifs(points, window, dims[0], dims[1], k)


def with_options(cfg: MotifConfig, **options) -> MotifConfig:
    return replace(cfg, **options)
