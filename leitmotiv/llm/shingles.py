"""N-gram Jaccard join: a count-vector R-tree.

A document is the set of its distinct word n-grams, as 64-bit hashes. The hashes fall into `groups` groups, and the counts by group are
the document's point. For two documents, the sum over groups of the smaller count bounds their overlap from above; the same
sum over two boxes' upper corners bounds it for all their points, which is how an R-tree over the points prunes. Pairs
that survive are held against their prefixes (below), and the rest is verified on the texts themselves.

Over a whole corpus, boxes of random documents overlap in all dimensions, so one R-tree would end in comparing everything.
Hence the points are first dealt out without loss: two sets that reach the threshold share one of the first
n - ceil(t n) + 1 hashes of each, whatever one order of hashes they are taken in. The order puts hashes that many documents
of a bounded sample hold last, so few buckets are large; the sample changes the order only, never the result. An R-tree is built for
each bucket.

Groups of copies: equal sets are one class, compared once. Within a bucket, all members are first compared with its smallest one
only; what this links is one component. Then the bucket's members are searched again for pairs between different components. So
a group of near copies costs about as many pairs as it has members, every pair within a bucket is linked, verified as
too far, or inside one component, and no link between components is lost. A large bucket is split into cells of bounded size.

Defined results: null and empty texts, and white space alone, have no shingles and are linked with nothing; their component is their own
id. Fewer words than a shingle: the whole sequence is one. Rows with one id are one node, each keeps its own row. A null id is linked
with nothing and its component is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leitmotiv.llm.common import batches_of, connected_components, materialize, sent, slices, utf8

#: Documents whose hashes are counted to order them, a bound for any corpus; and in how many of them a hash must be to come last.
ORDER_SAMPLE = 30_000
COMMON = 3
#: The list of such hashes goes to all executors; it has at most so many (32 MB), those of the most documents.
MOST_COMMON = 4_000_000
GROUPS = 256
CELL = 1024
LEAF = 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words, given the words' hashes; of the whole, if there are fewer."""
    if not len(h):
        return h
    n = min(size, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(mix(out + np.uint64(n)))


def word_hashes(texts: list[bytes], at_once: int = 500) -> Iterator[np.ndarray]:
    """Of each text: the hashes of its words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    for k in range(0, len(texts), at_once):
        number: dict[bytes, int] = {}
        add, size = number.setdefault, number.__len__
        coded = [np.array([add(w, size()) for w in text.lower().split()], np.int64) for text in texts[k : k + at_once]]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        for c in coded:
            yield hashes[c]


def reaches(overlap, a, b, percent: int):
    """100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


SKETCH = "id long, n long, s1 long, s2 long, points binary, prefix array<long>"


def _sketches(batches: Iterator[pa.RecordBatch], size: int, percent: int, groups: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in slices(batches):
        out = {"n": [], "s1": [], "s2": [], "points": [], "prefix": []}
        for h in word_hashes(utf8(batch.column(1))):
            u = shingles(h, size)
            s = xxhash.xxh3_128_digest(u.tobytes())
            late = _among(u, common)
            p = prefix_length(len(u), percent) if len(u) else 0
            first = u[~late][:p]
            if len(first) < p:
                first = np.concatenate([first, u[late][: p - len(first)]])
            out["n"].append(len(u))
            out["s1"].append(int.from_bytes(s[:8], "little", signed=True))
            out["s2"].append(int.from_bytes(s[8:], "little", signed=True))
            out["points"].append(encode_points(np.bincount((u % np.uint64(groups)).astype(np.int64), minlength=groups)))
            out["prefix"].append(first.view(np.int64))
        yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | out | {"prefix": pa.array(out["prefix"], longs)})


def _among(u: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of u are in the sorted array."""
    return common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u if len(common) else np.zeros(len(u), bool)


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """The hashes that at least COMMON of a sample of ORDER_SAMPLE documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for h in word_hashes(utf8(b.column(0))):
                yield pa.RecordBatch.from_pydict({"h": shingles(h, size).view(np.int64)})

    ids = docs.select("id").orderBy(F.xxhash64("id"), "id").limit(ORDER_SAMPLE).distinct()
    counted = docs.join(F.broadcast(ids), "id", "left_semi").select("text").mapInArrow(run, "h long").groupBy("h").count()
    counted = materialize(counted.where(F.col("count") >= COMMON), "common")
    least, held = COMMON, 0
    for count, n in sorted(counted.groupBy("count").agg(F.count("*")).collect(), reverse=True):  # one row a count, of ORDER_SAMPLE at most
        held += n
        if held > MOST_COMMON:
            least = count + 1
            break
    found = counted.where(F.col("count") >= least).select("h").toArrow()["h"]
    return np.sort(np.asarray(found).view(np.uint64))


def encode_points(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest: 1, 2 or 4."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def decode_points(blobs: list[bytes], groups: int) -> np.ndarray:
    widths = {len(b) // groups for b in blobs}
    if len(widths) == 1:
        w = widths.pop()
        return np.frombuffer(b"".join(blobs), f"<u{w}").reshape(-1, groups).astype(np.int16 if w == 1 else np.int32)
    return np.stack([np.frombuffer(b, f"<u{len(b) // groups}").astype(np.int32) for b in blobs])


def upper_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of a with all rows of b."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, 2_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.minimum(a[k : k + step, None, :], b[None, :, :]).sum(2, dtype=np.int64)
    return out


class CountVectorTree:
    """A packed R-tree of two levels over points, ordered by size: leaves of LEAF points, each with its upper corner and sizes."""

    def __init__(self, n: np.ndarray, points: np.ndarray) -> None:
        self.order = np.lexsort((points.argmax(1), n))
        self.n, self.points = n[self.order], points[self.order]
        self.starts = np.arange(0, len(n), LEAF)
        self.corner = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.least, self.most = self.n[self.starts], self.n[np.minimum(self.starts + LEAF, len(n)) - 1]

    def pairs(self, percent: int, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers that the bounds leave; apart: labels, pairs of one label are left out."""
        label = apart[self.order]
        bound = upper_bounds(self.corner, self.corner)
        smallest = self.least[:, None] + self.least[None, :]
        # An overlap is no more than the smaller set, so sizes alone rule out leaves that are too far apart.
        alive = reaches(bound, smallest, 0, percent) & (100 * self.most[:, None] >= percent * self.least[None, :]) & (100 * self.most[None, :] >= percent * self.least[:, None])
        for x, y in zip(*np.nonzero(np.triu(alive))):
            a = slice(self.starts[x], self.starts[x] + LEAF)
            b = slice(self.starts[y], self.starts[y] + LEAF)
            differ = label[a, None] != label[None, b]
            if not differ.any():
                continue
            ok = differ & reaches(upper_bounds(self.points[a], self.points[b]), self.n[a, None], self.n[None, b], percent)
            if x == y:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            if len(i):
                yield self.order[i + self.starts[x]], self.order[j + self.starts[y]]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first `keys` columns, across batches; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys))
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _points(column: pa.ChunkedArray, groups: int) -> np.ndarray:
    return decode_points(column.to_pylist(), groups)


def _search(batches: Iterator[pa.RecordBatch], percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids of different components that an R-tree over each cell leaves. Columns: key, i, j, id, n, component, points."""
    seen: set[tuple[int, int]] = set()
    for cell in runs(batches, 3):
        if cell.num_rows < 2:
            continue
        ids = np.asarray(cell.column(3))
        label = np.asarray(cell.column(5))
        if (label == label[0]).all():
            continue
        tree = CountVectorTree(np.asarray(cell.column(4)), _points(cell.column(6), groups))
        for i, j in tree.pairs(percent, label):
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            new = [p for p in zip(a.tolist(), b.tolist()) if p not in seen]
            if new:
                if len(seen) > 500_000:
                    seen.clear()  # repeats go later anyway
                seen.update(new)
                yield pa.RecordBatch.from_pydict({"a": [p[0] for p in new], "b": [p[1] for p in new]})


def _bounded(batches: Iterator[pa.RecordBatch], percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x, y = _points(b.column(3), groups), _points(b.column(5), groups)
        ok = reaches(np.minimum(x, y).sum(1, dtype=np.int64), np.asarray(b.column(2)), np.asarray(b.column(4)), percent)
        yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(pa.array(ok)), "b": b.column(1).filter(pa.array(ok))})


def _ordered(batches: Iterator[pa.RecordBatch], percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes leave enough. Up to the earlier of the two prefixes' last hashes both sets are known in full; past it
    they share at most what the one with less left has. Columns: a, b, n_a, prefix_a, n_b, prefix_b."""

    def within(p: np.ndarray, late: np.ndarray, m: tuple) -> np.ndarray:
        return p[(late < m[0]) | ((late == m[0]) & (p <= m[1]))]

    for batch in slices(batches):
        keep = []
        for n_a, p_a, n_b, p_b in zip(batch.column(2).to_pylist(), _lists(batch.column(3)), batch.column(4).to_pylist(), _lists(batch.column(5))):
            late_a, late_b = _among(p_a, common), _among(p_b, common)
            m = min((bool(late_a[-1]), int(p_a[-1])), (bool(late_b[-1]), int(p_b[-1])))
            x, y = within(p_a, late_a, m), within(p_b, late_b, m)
            most = len(np.intersect1d(x, y, assume_unique=True)) + min(n_a - len(x), n_b - len(y))
            keep.append(bool(reaches(most, n_a, n_b, percent)))
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))})


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep, memo = [], {}
        ids, texts = np.asarray(batch.column(0)), utf8(batch.column(2))
        hashes = word_hashes(texts + utf8(batch.column(3)))
        for k, h in enumerate(hashes):
            u = shingles(h, size)
            if k < len(ids):
                memo[k] = u
            else:
                v = memo[k - len(ids)]
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(bool(reaches(both, len(u), len(v), percent)))
        yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))})


def link_documents(docs: DataFrame, size: int = 3, percent: int = 90, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each row: sets link when 100 * overlap >= percent * union."""
    if not 50 <= percent <= 100:
        raise ValueError("percent: 50 to 100")
    spark = docs.sparkSession
    with batches_of(spark, 2000):  # all Python steps run before this returns
        return _link(docs, size, percent, groups, id_col, text_col)


def _link(docs: DataFrame, size: int, percent: int, groups: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = spark.sparkContext.broadcast(_common(base, size))  # MOST_COMMON at most
    sketch = materialize(base.mapInArrow(lambda b: _sketches(b, size, percent, groups, common.value), SKETCH), "sketches")

    real = sketch.where("n > 0 and id is not null")
    classes = real.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    members = materialize(real.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"]).select("id", "n", "rep").distinct(), "classes")
    own = classes.select(F.col("rep").alias("id"), "s1", "s2")
    reps = materialize(real.join(own, ["id", "s1", "s2"]).dropDuplicates(["id", "s1", "s2"]).select("id", "n", "points", "prefix"), "representatives")

    bucket = reps.select(F.explode("prefix").alias("key"), "id")
    centre = bucket.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last")
    pairs = bucket.join(centre, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("points").alias(f"p_{x}"))

    def ordered(found: DataFrame) -> DataFrame:
        known = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"))
        both = found.join(known("a"), "a").join(known("b"), "b").select("a", "b", "n_a", "p_a", "n_b", "p_b")
        return both.mapInArrow(lambda b: _ordered(b, percent, common.value), "a long, b long")

    def verify(found: DataFrame) -> DataFrame:
        met = materialize(found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct(), "met")
        # Both sides of the join read texts at once, and row groups of the caller's may be large: so those that are asked for are written first.
        texts = materialize(base.where("id is not null and text is not null").join(sent(met), "id", "left_semi"), "texts")
        text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
        both = found.join(text("a"), "a").join(text("b"), "b").select("a", "b", "t_a", "t_b")
        return both.mapInArrow(lambda b: _verified(b, size, percent), "a long, b long").distinct()

    sized = pairs.join(side("a"), "a").where(F.col("n_a") > 0).join(side("b"), "b").where("100 * least(n_a, n_b) >= " + f"{percent} * greatest(n_a, n_b)")
    bounded = sized.select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(lambda b: _bounded(b, percent, groups), "a long, b long")
    links = verify(materialize(ordered(materialize(bounded, "bounded")), "pairs"))
    # Rows of one id with different texts are members of several classes, which that links.
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last")
    links = links.unionByName(members.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b")))
    links = materialize(links, "links")
    label = materialize(connected_components(links), "labels")

    marked = reps.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = marked.select(F.explode("prefix").alias("key"), "id", "component")
    mixed = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    cells = F.greatest(F.lit(1), F.ceil(F.col("members") / CELL).cast("int"))
    rows = spread.join(mixed.select("key", cells.alias("cells")), "key")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    rows = rows.select("key", "id", "component", "c", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("o"))
    rows = rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "id", "component")
    rows = rows.join(reps.select("id", "n", "points"), "id").select("key", "i", "j", "id", "n", "component", "points")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = materialize(rows.mapInArrow(lambda b: _search(b, percent, groups), "a long, b long").distinct(), "rest")
    more = verify(materialize(ordered(rest), "ordered"))
    at = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = materialize(connected_components(joined), "joined")

    final = label.join(over.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    final = final.unionByName(over.join(label, over["node"] == label["node"], "left_anti").select("node", "component"))
    found = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sketch.select("id", "n").join(found, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def oracle_sql(size: int = 3, percent: int = 90, blank: str = "'[^\\x20\\x09-\\x0D]+'") -> str:
    """DuckDB SQL: all pairs that share a shingle, counted, and the smallest id reachable by a recursive query."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {blank})"
    return f"""
with recursive w as (
  select doc_id, {words} as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < {size} then [array_to_string(words, ' ')]
    else list_transform(range(len(words) - {size - 1}), lambda i: array_to_string(words[i + 1 : i + {size}], ' ')) end) as shingle from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as overlap from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where {100 + percent} * overlap >= {percent} * (na.n + nb.n)
), reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
from documents d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
"""
