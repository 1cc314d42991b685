"""Embedding near-dedup: sorted projection passes.

In each pass every vector gets a key of concatenated random sign bits; the vectors are sorted by it, and each is compared with
its `window` next neighbours in that order. Verified pairs of all passes are united into components. The first passes are as many as the
wanted recall needs at the threshold if all sign buckets were equally full. Where vectors crowd in one direction, a bucket holds more than a window and a
pass meets fewer pairs; so further rounds follow, each of as many passes as all before it together, until a round links no two components.

Equal vectors are one class, compared once. A pass only passes on a spanning forest of what it links within a block, so groups of near
copies cost rows in proportion to their members. Then the exact part: within each component all pairs are compared, in cells of
bounded size, which gives every member's number of links, however far apart in the sorted orders the copies were. Only links
between different components depend on the recall, which stays a probability: a lone pair in a crowd may be missed by all rounds.

Defined results: vectors that are null, empty, zero, or hold a null or a component that isn't finite link with nothing, and are their own
component; so are vectors with a null id, whose component is null. Vectors of different lengths don't link. Rows that repeat an id count as vectors
of their own. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leitmotiv.llm.common import connected_components, materialize
from leitmotiv.llm.shingles import runs

BITS = 63
BLOCK = 2048
CELL = 512


def passes_needed(vectors: int, window: int, threshold: float, recall: float) -> int:
    """A pair at the threshold shares the bits that tell windows apart with probability p ** bits; so many passes miss it together."""
    bits = max(1.0, math.log2(max(2, vectors) / window))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch], passes: range, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[tuple[int, int], np.ndarray] = {}
    weight = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    for b in batches:
        dims = np.asarray(b.column(1))
        for dim in np.unique(dims).tolist():
            own = b.filter(pa.array(dims == dim))
            x = _unit(_matrix(own.column(2), dim))
            for p in passes:
                if (p, dim) not in planes:
                    planes[p, dim] = np.random.default_rng((seed, p, dim)).standard_normal((dim, BITS))
                key = ((x @ planes[p, dim]) > 0) @ weight
                yield pa.RecordBatch.from_pydict({"pass": np.full(len(key), p, np.int32), "dim": np.full(len(key), dim, np.int32), "key": key, "rep": own.column(0)})


def _forest(links: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The smallest row number each row is linked with, directly or not."""
    label = np.arange(size)
    if links:
        i, j = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


def _windows(table: pa.Table, window: int, threshold: float) -> pa.Table:
    """Spanning edges of the links found within a block between different components. Columns: block, rank, pass, dim, rep, component, vec."""
    table = table.sort_by("rank")
    dims, turn = np.asarray(table["dim"]), np.asarray(table["pass"])
    ids, component = np.asarray(table["rep"]), np.asarray(table["component"])
    a, b = [], []
    for dim in np.unique(dims).tolist():
        for p in np.unique(turn[dims == dim]).tolist():
            at = np.flatnonzero((dims == dim) & (turn == p))
            x = _unit(_matrix(table["vec"].take(pa.array(at)), dim))
            links, group = [], component[at]
            for k in range(0, len(at), window):
                s = x[k : k + window] @ x[k : k + 2 * window].T
                i, j = np.nonzero(s >= threshold)
                ok = (j > i) & (j - i <= window) & (group[i + k] != group[j + k])
                links.append((i[ok] + k, j[ok] + k))
            label = _forest(links, len(at))
            own = ids[at]
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, label, own)
            centre = least[label]
            a.append(own[own != centre])
            b.append(centre[own != centre])
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return pa.table({"a": join(a), "b": join(b)})


def _count(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each cell (component, i, j) and member: the copies it links with there. Columns: component, i, j, c, rep, copies, dim, vec."""
    for cell in runs(batches, 3):
        ids, copies, c = np.asarray(cell["rep"]), np.asarray(cell["copies"]), np.asarray(cell["c"])
        i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
        x = _unit(_matrix(cell["vec"], cell["dim"][0].as_py()))
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        s = (x[left] @ x[right].T) >= threshold
        if i == j:
            np.fill_diagonal(s, False)
        out = {"rep": ids[left], "links": s @ copies[right]}
        yield pa.RecordBatch.from_pydict(out)
        if i != j:
            yield pa.RecordBatch.from_pydict({"rep": ids[right], "links": s.T @ copies[left]})


def _pass_edges(reps: DataFrame, label: DataFrame, n: int, passes: range, window: int, threshold: float, seed: int) -> DataFrame:
    """a, b: links between different components of label that the passes meet."""
    spark = reps.sparkSession
    keyed = reps.select("rep", "dim", "vec").mapInArrow(lambda b: _keys(b, passes, seed), "pass int, dim int, key long, rep long")
    parts = max(8, math.ceil(n * len(passes) / 200_000))
    ordered = keyed.repartitionByRange(parts, "pass", "dim", "key", "rep").sortWithinPartitions("pass", "dim", "key", "rep")
    ordered = ordered.select("pass", "dim", "rep", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    ordered = materialize(ordered, "order")
    sizes = sorted(ordered.groupBy("part").count().collect())  # one row a partition
    before, rows = 0, []
    for part, size in sizes:
        rows.append((part, before))
        before += size
    offset = spark.createDataFrame(rows, "part int, before long")
    ranked = ordered.join(F.broadcast(offset), "part").select("pass", "dim", "rep", (F.col("pos") + F.col("before")).alias("rank"))
    block = F.floor(F.col("rank") / BLOCK)
    # The first rows of a block also close the block before it.
    ranked = ranked.withColumn("block", F.explode(F.when(F.col("rank") % BLOCK < window, F.array(block, block - 1)).otherwise(F.array(block))))
    own = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "vec")
    met = ranked.join(own, "rep").select("block", "rank", "pass", "dim", "rep", "component", "vec")
    return met.groupBy("block").applyInArrow(lambda t: _windows(t, window, threshold), "a long, b long")


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, window: int = 128, recall: float = 0.999, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id_col, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    real = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2")]
    usable = base.where(real & F.col("id").isNotNull()).select("id", "vec", *hashes)
    # All copies of a class are equal, so any one's vector will do; the id only decides which is kept.
    classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = usable.join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"])
    reps = materialize(reps.select("h1", "h2", "rep", "copies", F.size("vec").alias("dim"), "vec"), "vectors")
    n = reps.count()
    done, passes = 0, passes_needed(n, window, threshold, recall)
    label = reps.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    while not (edges := materialize(_pass_edges(reps, label, n, range(done, done + passes), window, threshold, seed), "links")).isEmpty():
        label = materialize(connected_components(edges.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))), "labels")
        done += passes
        passes = max(passes, done)

    sized = label.groupBy("component").agg(F.count("*").alias("members"))
    members = label.join(sized, "component").withColumnRenamed("node", "rep").join(reps.select("rep", "copies", "dim", "vec"), "rep")
    cells = F.ceil(F.col("members") / CELL).cast("int")
    members = members.withColumn("cells", cells).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    spread = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    spread = spread.select("component", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "copies", "dim", "vec")
    spread = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = spread.mapInArrow(lambda b: _count(b, threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))

    found = reps.select("h1", "h2", "rep", "copies").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    found = found.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keys = base.select("id", *[F.when(real & F.col("id").isNotNull(), h).alias(f"k{k}") for k, h in enumerate(hashes)])
    out = keys.join(found, (F.col("k0") == F.col("h1")) & (F.col("k1") == F.col("h2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def oracle_sql(threshold: float = 0.9) -> str:
    return f"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
), u as (
  select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_inner_product(x.e, y.e) / (x.norm * y.norm) >= {threshold}
), reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select reach.vec_id, links.b from reach join links on links.a = reach.other
), c as (
  select vec_id, min(other) as component_id from reach group by vec_id
), k as (
  select a as vec_id, count(*) as n from links group by a
)
select c.vec_id, coalesce(k.n, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join k using (vec_id)
"""
