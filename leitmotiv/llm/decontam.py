"""Benchmark decontamination: CGK embedding and bit sampling over item-sized windows.

The CGK walk reads a string of words from left to right and writes its current word at each step; a random bit of (step, word) says
whether it goes on to the next word. Of its 3 L steps the first L are taken, as two walks drift apart with every step. Two strings at a small edit distance write the same words at most steps, so
edit distance becomes Hamming distance. Each of R repetitions has its own walk and samples a few steps; a window whose sampled words
all equal an item's is a candidate, and an exact edit distance decides. R is what simulated edits of the items at the largest
allowed distance need for the wanted recall.

Items longer than SEGMENT words are embedded in segments, each with its share of the allowed edits, rounded down: a match of the whole has one segment
within its share, so nothing is lost, and cost grows in proportion to the item's length.

Windows are as long as the segment. Those without an untouched piece can't be within its distance: an item with e allowed edits is cut into e + 1
pieces, one of which any match holds unchanged, at most e words from its place. So only windows at such places are
embedded, which loses nothing, and a text without any piece costs one lookup a word.

Items go to the executors in blocks of about BLOCK_CHARS characters, each block against all documents; the driver gathers and indexes one block at a time. Documents are
read in one pass for each block; nothing is shuffled.

Words are lower-cased (A-Z) runs of letters, digits and characters past ASCII. The default distance is a fifth of the item's words.

Defined results: items of fewer than `least` words (4) match nothing, as any text may have these; a null or empty text leaks nothing. Equal items each match. Rows that repeat an id each
give their own pairs. A text of any length is searched as a whole.
"""

from __future__ import annotations

import math
import warnings
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leitmotiv.llm.common import slices, utf8
from leitmotiv.llm.licenses import WORD

BLOCK_CHARS = 8_000_000
SAMPLED = 2
SEGMENT = 192
LEAST = 4
MOST_REPETITIONS = 96
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def word_symbols(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words; 0 is none's."""
    memo: dict[bytes, int] = {}
    for text in texts:
        words = WORD.findall(text.lower())
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w) or 1
        yield np.fromiter((memo[w] for w in words), np.uint64, len(words))
        if len(memo) > 500_000:
            memo.clear()


def extend(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of runs one word longer: g of the runs so far, h of the words that follow them."""
    x = g * C1 + h
    x = (x ^ (x >> np.uint64(29))) * C3
    return x ^ (x >> np.uint64(32))


def edit_distance_in(item: np.ndarray, area: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any run of area, and the first place where such a run starts.

    Both are read backwards, so that the last row has the least distance of the runs that start at each place."""
    item, area = np.asarray(item, np.uint64)[::-1], np.asarray(area, np.uint64)[::-1]
    ramp = np.arange(len(area) + 1)
    row = np.zeros(len(area) + 1, np.int64)
    for i, x in enumerate(item, 1):
        new = row + 1
        new[0] = i
        new[1:] = np.minimum(new[1:], row[:-1] + (area != x))
        row = np.minimum.accumulate(new - ramp) + ramp
    at = len(area) - np.flatnonzero(row == row.min())[-1]
    return int(row.min()), int(at)


class LeakIndex:
    """items: (id, text); share: allowed edits as a share of the item's words; recall: of matches at that distance."""

    def __init__(self, items: list[tuple], share: float = 0.2, recall: float = 0.999, seed: int = 5, repetitions: int | None = None, least: int = LEAST, segment: int = SEGMENT) -> None:
        coded = list(word_symbols([(t or "").encode() for _, t in items]))
        self.ids = [i for (i, _), w in zip(items, coded) if len(w) >= max(1, least)]
        self.words = [w for w in coded if len(w) >= max(1, least)]
        self.edits = [int(len(w) * share + 1e-9) for w in self.words]
        self.rng = np.random.default_rng(seed)
        #: Of each segment: its item, where it starts there, its words, its allowed edits.
        self.segments: list[tuple[int, int, np.ndarray, int]] = []
        for k, (w, e) in enumerate(zip(self.words, self.edits)):
            n = -(-len(w) // segment)
            for x in range(n):
                a, b = x * len(w) // n, (x + 1) * len(w) // n
                self.segments.append((k, a, w[a:b], e * (b - a) // len(w)))
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, _, w, e) in enumerate(self.segments):
            for x in range(e + 1):
                a, b = x * len(w) // (e + 1), (x + 1) * len(w) // (e + 1)
                g = w[a : a + 1]
                for y in range(a + 1, b):
                    g = extend(g, w[y : y + 1])
                found[b - a][int(g[0])].append((k, a))
        self.pieces = {}
        for q, by in sorted(found.items()):
            keys = np.array(sorted(by), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.pieces[q] = (keys, bits, [by[int(x)] for x in keys])
        self.repetitions = repetitions or (self._calibrate(recall) if self.segments else 1)
        #: Of each segment: the sampled steps of each repetition, in order, and the words written there.
        self.sampled = [self._sampled(w, self._choose(len(w))) for _, _, w, _ in self.segments]

    def _choose(self, length: int) -> np.ndarray:
        """For each repetition, the sampled steps, of the first L."""
        steps = np.sort(np.stack([self.rng.choice(length, min(SAMPLED, length), replace=False) for _ in range(self.repetitions)]), axis=1)
        return steps if length >= SAMPLED else np.repeat(steps, SAMPLED, axis=1)

    def _sampled(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at.astype(np.int32), np.take_along_axis(self.walk(words, self.repetitions, int(at.max()) + 1), at, 1)

    def _step(self, symbol: np.ndarray, j: int, r: np.ndarray) -> np.ndarray:
        return (((symbol ^ (r.astype(np.uint64) * C2 + np.uint64(j * int(C1) & 0xFFFFFFFFFFFFFFFF))) * C3) >> np.uint64(63)).astype(np.int64)

    def walk(self, words: np.ndarray, repetitions: int, steps: int) -> np.ndarray:
        """The words written at each step (0 past the end): repetitions x steps."""
        r, at = np.arange(repetitions), np.zeros(repetitions, np.int64)
        padded = np.append(words, np.uint64(0))
        out = np.zeros((repetitions, steps), np.uint64)
        for j in range(steps):
            out[:, j] = s = padded[np.minimum(at, len(words))]
            at = at + self._step(s, j, r)
        return out

    def _calibrate(self, recall: float, trials: int = 300) -> int:
        """Repetitions that find `recall` of simulated segments with the most allowed edits; warns where MOST_REPETITIONS don't."""
        self.repetitions, hits = MOST_REPETITIONS, []
        for t in range(trials):
            _, _, w, e = self.segments[int(self.rng.integers(len(self.segments)))]
            s = w.tolist()
            for _ in range(e):
                at, kind = int(self.rng.integers(len(s))) if s else 0, int(self.rng.integers(3))
                new = int(self.rng.integers(1, 1 << 63))
                s[at : at + (kind != 1)] = [new] if kind != 2 else []
            at = self._choose(len(w))
            a, b = self.walk(w, self.repetitions, len(w)), self.walk(np.array(s, np.uint64), self.repetitions, len(w))
            same = np.take_along_axis(a, at, 1) == np.take_along_axis(b, at, 1)
            hits.append(same.all(1))
        met = np.any(hits, 1)
        if met.mean() < recall:
            warnings.warn(f"{MOST_REPETITIONS} repetitions find {met.mean():.3f} of simulated edits, not {recall}", stacklevel=3)
        first = np.where(met, np.argmax(hits, 1) + 1, self.repetitions)
        return int(max(4, np.quantile(first, recall, method="higher")))

    def _anchors(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, where the item would start) for each piece in a run of symbols."""
        if not self.pieces or not len(h):
            return
        g = h
        for q in range(1, max(self.pieces) + 1):
            if q > 1:
                if len(h) < q:
                    return
                g = extend(g[: len(h) - q + 1], h[q - 1 :])
            if q in self.pieces:
                keys, bits, where = self.pieces[q]
                for p in np.flatnonzero(bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)]):
                    at = int(np.searchsorted(keys, g[p]))
                    if at < len(keys) and keys[at] == g[p]:
                        for k, offset in where[at]:
                            yield k, int(p) - offset

    def candidates(self, h: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, segment, start) of windows that collide in a repetition. h: all documents' symbols, each followed by one 0; stops: where those are."""
        found = np.array(list(self._anchors(h)), np.int64).reshape(-1, 2)
        if not len(found):
            return []
        found = np.unique(found, axis=0)
        edits = np.array([e for _, _, _, e in self.segments])[found[:, 0]]
        reach = 2 * edits + 1
        offset = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) - np.repeat(edits, reach)
        item, start = np.unique(np.stack([np.repeat(found[:, 0], reach), np.repeat(found[:, 1], reach) + offset], 1), axis=0).T
        inside = (start >= 0) & (start < len(h))
        item, start = item[inside], start[inside]
        doc = np.searchsorted(stops, start)
        present, local = np.unique(item, return_inverse=True)
        lengths = np.array([len(self.segments[k][2]) for k in present])
        step, want = (np.stack([self.sampled[k][x] for k in present]) for x in (0, 1))  # segments x repetitions x SAMPLED
        reps = self.repetitions
        stop = np.minimum(stops[doc], start + lengths[local])
        hit: set[int] = set()
        chunk = max(1, 1_000_000 // reps)
        for c in range(0, len(start), chunk):
            n = min(chunk, len(start) - c)
            w, r = np.repeat(np.arange(c, c + n), reps), np.tile(np.arange(reps), n)
            at, end, x = start[w], stop[w], local[w]
            last = step[x, r, SAMPLED - 1]
            for j in range(int(last.max()) + 1):
                symbol = np.where(at < end, h[np.minimum(at, len(h) - 1)], np.uint64(0))
                at = at + self._step(symbol, j, r)
                bad = np.zeros(len(w), bool)
                for y in range(SAMPLED):
                    bad |= (step[x, r, y] == j) & (symbol != want[x, r, y])
                done = ~bad & (last == j)
                if done.any():
                    hit.update(np.unique(w[done]).tolist())
                if bad.any() or done.any():
                    ok = ~bad & ~done
                    w, r, at, end, x, last = w[ok], r[ok], at[ok], end[ok], x[ok], last[ok]
                    if not len(w):
                        break
        return sorted((int(doc[w]), int(item[w]), int(start[w])) for w in hit)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of the best match of each item in each text, within the allowed distance."""
        coded = list(word_symbols(texts))
        stops = np.cumsum([len(c) + 1 for c in coded]) - 1
        zero = np.zeros(1, np.uint64)
        h = np.concatenate([x for c in coded for x in (c, zero)]) if coded else zero
        groups: dict[tuple[int, int], set[int]] = defaultdict(set)
        for d, x, s in self.candidates(h, stops):
            k, offset, _, _ = self.segments[x]
            groups[d, k].add(s - offset)
        out = []
        for (d, k), starts in sorted(groups.items()):
            e, best = self.edits[k], None
            first, item = int(stops[d]) - len(coded[d]), self.words[k]
            places = sorted(starts)
            while places:
                run = [places.pop(0)]
                while places and places[0] - run[-1] <= e + 1:
                    run.append(places.pop(0))
                # A segment is off its place in the item by the edits before it, e at most.
                lo, hi = max(first, run[0] - 2 * e), min(int(stops[d]), run[-1] + len(item) + 2 * e)
                distance, at = edit_distance_in(item, h[lo:hi])
                if distance <= e and (best is None or distance < best[0]):
                    best = (distance, lo + at - first)
            if best:
                out.append((d, k, *best))
        return out


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, share: float, recall: float) -> Iterator[LeakIndex]:
    chars = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))  # equal items of different ids are dealt over the blocks
    for k in range(blocks):
        yield LeakIndex([tuple(r) for r in benchmark.where(part == k).select(id_col, text_col).orderBy(id_col, text_col).collect()], share, recall)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and item that it holds: id_col, item_col, distance (words edited), similarity, first_word."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index in _indexes(benchmark, item_col, item_text, share, recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches):
                if found := own.search(utf8(b.column(1))):
                    yield pa.RecordBatch.from_pydict({
                        "id": b.column(0).take(pa.array([f[0] for f in found])), "item": [own.ids[f[1]] for f in found],
                        "distance": [f[2] for f in found], "similarity": [1 - f[2] / len(own.words[f[1]]) for f in found], "first_word": [f[3] for f in found],
                    })

        part = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, item {item_kind}, distance long, similarity double, first_word long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.999, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text holds none of the items."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text, share, recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                leaking = {f[0] for f in shared.value.search(utf8(b.column(at)))}
                yield b.filter(pa.array([k not in leaking for k in range(b.num_rows)], pa.bool_())) if leaking else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
