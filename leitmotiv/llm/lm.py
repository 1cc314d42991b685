"""Language-model scoring with a weighted backoff automaton.

An n-gram model over words is an automaton: a state for each context that the training texts hold, an arc for each n-gram
with its log-probability, and a failure arc to the next shorter context with its weight, down to the root, whose arcs are the
smoothed words. A text is read once from left to right; at each word the state follows its arc, or failure arcs until one
is there, and the weights add up. Smoothing, with c the counts and k = `mass`:

    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),    p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k)

where h' is h without its first word. So an arc for hw has the log of the second formula, and h's failure arc that of k / (c(h) + k).

The n-grams grow with the corpus, so no one process holds them. Texts are cut into blocks. Each block lists its own distinct
n-grams as sorted 64-bit keys with their training counts; the lists are dealt over shards by key ranges, a shard sums the
counts over blocks and answers each list in its order, and a block builds the part of the automaton that its texts can reach and
walks them through it. A frequent n-gram is one entry a block, so no shard is hot. The counts cover all training texts, nothing is pruned.
What is shuffled is about five bytes for each distinct n-gram of a block; the blocks are written to the shared folder.

Keys of longer n-grams have 56 bits, words have 64; equal keys of different n-grams would add their counts.

Defined results: null and empty texts have one token, the end. A null id counts as the empty string, so it is held out. Repeated rows
each get their own row, and each counts in training. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leitmotiv.llm.common import batches_of, materialize, release, slices, utf8

END = b"\n"  # no word has white space
ADD = 0.1
BLOCK_BYTES = 6_000_000
SHARD_TOKENS = 800_000
HELD_OUT_OF = 10
#: Of blocks and lists that are sent to a worker at once.
BATCH_BYTES = 4_000_000


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


class BackoffAutomaton:
    """The part of the model that a block's texts walk through: states, arcs and failure arcs as arrays.

    State 0 is the root. An n-gram of fewer than `order` words that training texts hold is a state; its failure arc leads to the n-gram
    without its first word, with the weight of the backoff. An n-gram of any order that they hold is an arc from the state of its first
    words, and leads to the longest state its words end in. The root has an arc for every word of the block, also for unknown
    ones, so each word ends in one. Arcs of other states are found by binary search for (state, word).
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], positions: int, n_tokens: int, n_types: int, mass: float) -> None:
        """grams: for each order from 1, the distinct n-grams' counts, the positions where an n-gram ends, and its number there."""
        total = n_tokens + ADD * (n_types + 1)
        self.order = len(grams)
        counts, _, self.words = grams[0]
        p = (counts + ADD) / total
        self.types, self.root_log = len(counts), np.log10(p)
        self.known = counts > 0
        states = np.cumsum([1, *(len(c) for c, _, _ in grams[:-1])])  # the number of each order's first state
        self.root_to = np.where(self.known, states[0] + np.arange(len(counts)), 0) if self.order > 1 else np.zeros(len(counts), np.int64)
        self.fail_log, self.fail_to = np.zeros(int(states[-1])), np.zeros(int(states[-1]), np.int64)
        if self.order > 1:
            self.fail_log[1 : states[1]] = np.log10(mass / (counts + mass))
        number, before = self.words, counts  # the n-gram of one word less that ends at each position, and the counts of those
        keys, logs, to = [], [], []
        for n, (counts, at, inverse) in enumerate(grams[1:], 2):
            end = np.zeros(len(counts), np.int64)
            end[inverse] = at  # one place of each
            prefix, suffix = number[end - 1], number[end]
            p = (counts + mass * p[suffix]) / (before[prefix] + mass)
            real = np.flatnonzero(counts > 0)
            keys.append((states[n - 2] + prefix[real]) * self.types + self.words[end[real]])
            logs.append(np.log10(p[real]))
            to.append(states[n - 1] + real if n < self.order else states[n - 2] + suffix[real])
            if n < self.order:
                self.fail_log[states[n - 1] : states[n]] = np.log10(mass / (counts + mass))
                self.fail_to[states[n - 1] : states[n]] = states[n - 2] + suffix
                number = np.full(positions, -1)
                number[at] = inverse
                before = counts
        order = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)

        def arranged(parts: list[np.ndarray], kind: type) -> np.ndarray:
            whole = np.concatenate(parts) if parts else np.zeros(0, kind)
            parts.clear()  # one whole and its copy in memory at a time
            return whole[order]

        self.keys, self.logs, self.to = arranged(keys, np.int64), arranged(logs, float), arranged(to, np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights on the way there, failure arcs included, of many walks."""
        weight, out = self.root_log[word], self.root_to[word]  # of those that the root's arc takes in the end
        at = np.flatnonzero(state)
        s = state[at]
        spent = np.zeros(len(state))
        while len(at) and len(self.keys):
            key = s * self.types + word[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            weight[at[hit]], out[at[hit]] = self.logs[i[hit]], self.to[i[hit]]
            at, s = at[~hit], s[~hit]
            spent[at] += self.fail_log[s]
            s = self.fail_to[s]
            at, s = at[s > 0], s[s > 0]
        return out, weight + spent

    def walk(self, starts: np.ndarray, lane: int = 256) -> np.ndarray:
        """The weight of each word. The stream of texts is cut into lanes that are walked side by side, each from left to right; a lane begins
        order - 1 words early at the root, after which its state is the one that a walk from the text's start has."""
        early, n = self.order - 1, len(self.words)
        lanes = -(-n // lane)
        words = np.zeros(early + lanes * lane, np.int64)
        words[early : early + n] = self.words
        fresh = np.zeros(len(words), bool)
        fresh[early + starts] = True
        out, state, first = np.empty(lanes * lane), np.zeros(lanes, np.int64), np.arange(lanes) * lane
        for j in range(early + lane):
            state[fresh[first + j]] = 0
            state, weight = self.step(state, words[first + j])
            if j >= early:
                out[first + j - early] = weight
        return out[:n]


_COMPRESSED = 0x80


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs, compressed if that is shorter; the first byte says how many and whether."""
    n = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()
    short = zstandard.ZstdCompressor(level=1).compress(planes) if len(planes) > 64 else planes
    return bytes([n | _COMPRESSED]) + short if len(short) < len(planes) else bytes([n]) + planes


def unpack(b: bytes) -> np.ndarray:
    n, rest = b[0] & ~_COMPRESSED, b[1:]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(rest) if b[0] & _COMPRESSED else rest, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by the Elias-Fano code: the low bits as they are, the high bits' steps in unary. About two bits a number
    above log2(span / numbers), however short the list is."""
    if not len(keys):
        return b""
    base = keys[0]
    rest = keys - base
    low = max(0, (int(rest[-1]) // len(keys)).bit_length() - 1)
    bits = np.unpackbits(rest.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(len(keys))
    unary = np.zeros(int(high[-1]) + 1, bool)
    unary[high] = True
    return len(keys).to_bytes(4, "little") + bytes([low]) + int(base).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    n, low, base = int.from_bytes(b[:4], "little"), b[4], np.uint64(int.from_bytes(b[5:13], "little"))
    raw = np.frombuffer(b, np.uint8, offset=13)
    size = -(-n * low // 8)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :low] = np.unpackbits(raw[:size], bitorder="little", count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(raw[size:], bitorder="little"))[:n] - np.arange(n)
    return base + (high.astype(np.uint64) << np.uint64(low)) + np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BLOCK_SCHEMA = "block long, doc_ids array<{kind}>, lengths binary, train binary, vocabulary binary, tokens binary, n_tokens long, n_train long"


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA. Tokens are numbers of the block's own vocabulary, which holds the words' hashes; 0 is the end."""
    partition, n = TaskContext.get().partitionId(), 0

    def fresh() -> tuple:
        return {END: 0}, [], [], [], [], 0

    def row() -> pa.RecordBatch:
        lengths = np.array(sizes, np.uint64)
        train = np.array([not held_out(i) for i in ids], np.uint8)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        data = {
            "block": [(partition << 32) + n], "doc_ids": pa.array([ids], pa.list_(kind)), "lengths": [pack(lengths)], "train": [train.tobytes()],
            "vocabulary": [hashes.tobytes()], "tokens": [pack(np.concatenate(tokens))], "n_tokens": [int(lengths.sum())], "n_train": [int(lengths[train == 1].sum())],
        }
        return pa.RecordBatch.from_pydict(data)

    number, ids, sizes, tokens, _, held = fresh()
    for part in slices(batches, 500):
        for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
            words = text.lower().split()  # bytes: A-Z, and white space [\x20\x09-\x0D]
            add, size = number.setdefault, number.__len__
            coded = [add(w, size()) for w in words]
            coded.append(0)
            tokens.append(np.array(coded, np.uint32))
            ids.append(doc_id)
            sizes.append(len(coded))
            held += len(text) + 8
            if held >= block_bytes:
                yield row()
                n += 1
                number, ids, sizes, tokens, _, held = fresh()
    if ids:
        yield row()
    number, ids, sizes, tokens, _, held = fresh()
    release()


def _grams(row: dict, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: sorted distinct keys, which positions have such an n-gram, and its key's number at those.

    Keys are 64-bit for words and 56-bit, moved up by 8 bits, for longer n-grams; both spread over the whole range.
    """
    h = np.frombuffer(row["vocabulary"], np.uint64)
    t = unpack(row["tokens"]).astype(np.int32)  # a block has far fewer positions than that holds
    lengths = unpack(row["lengths"]).astype(np.int64)
    starts = (np.cumsum(lengths) - lengths).astype(np.int32)
    by_key = np.argsort(h)
    rank = np.empty(len(h), np.int32)
    rank[by_key] = np.arange(len(h))
    yield 1, h[by_key], np.arange(len(t), dtype=np.int32), rank[t]
    if order > 1:
        offset = np.arange(len(t), dtype=np.int32) - np.repeat(starts, lengths)
        token_hash = h[t]
        del t
        key = token_hash
        for n in range(2, order + 1):
            longer = np.empty_like(key)
            longer[1:] = _mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(token_hash[1:] + np.uint64(n)))
            longer[:1] = 0
            key = longer
            del longer
            at = np.flatnonzero(offset >= n - 1).astype(np.int32)
            yield n, *_distinct(key[at] & np.uint64(0xFFFFFFFFFFFFFF00), at)


def _distinct(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, at, and each key's number; own is overwritten, as np.unique would hold several more copies."""
    by_key = np.argsort(own).astype(np.int32)
    own[:] = own[by_key]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    inverse = np.empty(len(own), np.int32)
    inverse[by_key] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return own[first], at, inverse


def _edges(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)  # as long as the shards are many


REQUESTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _requests(row: dict, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A batch of REQUESTS for each order, so that one order's lists are in memory."""
    train = np.repeat(np.frombuffer(row["train"], bool), unpack(row["lengths"]).astype(np.int64))
    for n, keys, at, inverse in _grams(row, order):
        counts = np.bincount(inverse[train[at]], minlength=len(keys)).astype(np.uint64)
        del at, inverse
        out: dict[str, list] = {c: [] for c in REQUESTS.names}
        cuts = np.r_[0, np.searchsorted(keys, _edges(shards)), len(keys)]
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[shard], cuts[shard + 1])
            own = keys[s] >> np.uint64(8) if n > 1 else keys[s]
            for c, v in (("shard", shard), ("block", row["block"]), ("n", n), ("keys", pack_sorted(own)), ("counts", pack(counts[s]))):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, REQUESTS)


def _answer(table: pa.Table) -> pa.Table:
    """Totals for each list of a shard, in its order; and how many different words it has (block -1)."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["block"]))
    out, types = {"block": [], "n": [], "shard": [], "totals": [], "types": []}, 0
    for n in sorted({r["n"] for r in rows}):
        own = [r for r in rows if r["n"] == n]
        lists = [unpack_sorted(r["keys"]) for r in own]
        keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([unpack(r["counts"]) for r in own]), minlength=len(keys)).astype(np.uint64)
        types += int((totals > 0).sum()) if n == 1 else 0
        at = 0
        for r, keys_of in zip(own, lists):
            for k, v in (("block", r["block"]), ("n", n), ("shard", r["shard"]), ("totals", pack(totals[inverse[at : at + len(keys_of)]])), ("types", 0)):
                out[k].append(v)
            at += len(keys_of)
        del lists, keys, inverse, totals
    for k, v in (("block", -1), ("n", 1), ("shard", rows[0]["shard"]), ("totals", b""), ("types", types)):
        out[k].append(v)
    return pa.table(out, ANSWERS)


ANSWERS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary()), ("types", pa.int64())])
ANSWER_SCHEMA = "block long, n int, shard int, totals binary, types long"


def _score(row: dict, answers: list[dict], order: int, mass: float, n_tokens: int, n_types: int) -> dict[str, np.ndarray]:
    """Builds a block's automaton and walks its texts."""
    lengths = unpack(row["lengths"]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    by: dict[int, list] = {}
    for a in sorted(answers, key=lambda a: (a["n"], a["shard"])):
        by.setdefault(a["n"], []).append(unpack(a["totals"]))
    grams = []
    for n, _, at, inverse in _grams(row, order):
        grams.append((np.concatenate(by.pop(n)).astype(np.float64) if n in by else np.zeros(0), at, inverse))
    model = BackoffAutomaton(grams, int(lengths.sum()), n_tokens, n_types, mass)
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  each text has its end, so none is empty
    return {"n_tokens": lengths, "n_known": add(model.known[model.words].astype(np.int64)), "base_score": add(model.root_log[model.words]), "score": add(model.walk(starts))}


def score_documents(docs: DataFrame, order: int = 2, mass: float = 5.0, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    with batches_of(spark, 500):  # of texts: the JVM holds a batch beside its heap, in room that doubles, and a worker one at a time
        blocks = materialize(docs.select(id_col, text_col).mapInArrow(lambda b: _blocks(b, arrow_kind, block_bytes), BLOCK_SCHEMA.format(kind=kind)), "lm-blocks")
    n_all, n_train = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    shards = max(8, math.ceil(n_all / SHARD_TOKENS))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield from _requests(*batch.to_pylist(), order, shards)

    def answer(table: pa.Table) -> pa.Table:
        out = _answer(table)
        release()
        return out

    asked = blocks.select("block", "lengths", "train", "vocabulary", "tokens").mapInArrow(requests, "shard int, block long, n int, keys binary, counts binary")
    with batches_of(spark, 500, BATCH_BYTES):
        answers = materialize(asked.groupBy("shard").applyInArrow(answer, ANSWER_SCHEMA), "lm-answers")
    n_types = answers.where("block = -1").agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        answered = right.to_pylist()
        for row in left.to_pylist():
            found = _score(row, answered, order, mass, n_train, n_types)
            ids = pa.array(row["doc_ids"], arrow_kind)
            held = [held_out(i) for i in row["doc_ids"]]
            out.append(pa.table({
                "id": ids, "held_out": held, "n_tokens": found["n_tokens"], "n_known": found["n_known"],
                "train_tokens": pa.array(np.full(len(ids), n_train, np.int64)), "base_score": found["base_score"], "score": found["score"],
            }))
        release()
        return pa.concat_tables(out) if out else pa.schema([("id", arrow_kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    left = blocks.drop("n_tokens", "n_train", "train").groupBy("block")
    right = answers.where("block >= 0").select("block", "n", "shard", "totals").groupBy("block")
    out = left.cogroup(right).applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
