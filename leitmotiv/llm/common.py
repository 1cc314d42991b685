"""What the text operators share: written intermediate tables, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder and its executors are this machine's.
LOCAL_WORKSPACE = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def workspace(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or with a local master a local one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or LOCAL_WORKSPACE).rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading of a file again, not the work before it.
    The folder goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/leitmotiv/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: A list of at most so many ids (some 40 MB as a hash table) goes to all executors.
SENT_IDS = 500_000


def sent(ids: DataFrame) -> DataFrame:
    """A written list of ids; if it is short it goes to all executors, so that rows with texts aren't shuffled to meet it in a join."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone already; then the folder's owner clears it
            return


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of at most so many rows, and about so many bytes if given, for what runs inside; then the session's own settings are back."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: What a Python worker keeps from task to task: by kind, a key and a value.
_kept: dict[str, tuple[Any, Any]] = {}


def kept(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """A worker's own value, made once for a key and kept until a step of another kind runs in the worker."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, kind: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices without copies, so that the Python objects made of them stay few.

    Workers outlive their tasks and stand beside the heap of the stages after them. So what other kinds of steps kept goes first, and
    freed memory goes back to the system last.
    """
    for other in [k for k in _kept if k != kind]:
        del _kept[other]
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def release() -> None:
    """Gives a worker's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str, kind: str = "") -> DataFrame:
    """mapInArrow with a function from a slice of a batch to columns named as in schema. kind: as in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, kind=kind):
            if (columns := function(batch)) is not None:
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps, each a grouped minimum joined back to the edges, so that
    no node's neighbours are gathered in one task (the join's skewed keys can be split). Each round is written
    to the shared folder. Nulls in a or b and loops don't link anything.
    """
    spark = edges.sparkSession

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = materialize(step(step(now, True), False), "stars")
        then, seen = seen, mark(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
