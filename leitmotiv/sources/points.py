"""Tables and files to points(series_id, t, dim, value): one row for each time and dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("t", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("value", T.DoubleType())])


def from_wide(df: DataFrame, time_col: str, value_cols: list[str] | None = None, series_id: str = "s") -> DataFrame:
    """Columns become dimensions, in their order; time_col is the integer time."""
    cols = value_cols or [c for c in df.columns if c != time_col]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return df.select(F.lit(series_id).alias("series_id"), F.col(time_col).cast("bigint").alias("t"), F.posexplode(values).alias("dim", "value"))


def from_arrays(df: DataFrame, time_col: str, array_col: str, first: int | None = None, series_id: str = "s") -> DataFrame:
    """Array components become dimensions, the first `first` of them if given."""
    values = F.col(array_col) if first is None else F.slice(array_col, 1, first)
    out = df.select(F.col(time_col).cast("bigint").alias("t"), F.posexplode(values).alias("dim", "value"))
    return out.select(F.lit(series_id).alias("series_id"), "t", "dim", F.col("value").cast("double").alias("value"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds t: each row's number from 0 in the order of the columns.

    Numbers come from sorted partitions and their counts, one row a partition on the driver, not from one global window.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    rows, before = [], 0
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        rows.append((part, before))
        before += n
    offset = spark.createDataFrame(rows, "_part int, _before bigint")
    return placed.join(F.broadcast(offset), "_part").withColumn("t", F.col("_pos") + F.col("_before")).drop("_part", "_pos", "_before")


def read_csv(spark: SparkSession, path: str, drop: tuple[str, ...] = (), time_col: str | None = None, series_id: str = "s") -> DataFrame:
    """A header and numeric columns; those in drop are left out. Without time_col, rows are numbered in the order of the file."""
    df = spark.read.csv(path, header=True)
    cols = [c for c in df.columns if c not in drop and c != time_col]
    return _in_order(df, cols, time_col, series_id)


def read_whitespace(spark: SparkSession, path: str, series_id: str = "s", drop_first: bool = True) -> DataFrame:
    """Columns between runs of white space, of which the first is time and left out."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v"), *_file_order()).where(F.element_at("v", 1) != "")
    values = F.slice("v", 2, F.size("v") - 1) if drop_first else F.col("v")
    out = numbered(rows, *PLACE).select("t", F.posexplode(F.transform(values, lambda x: x.cast("double"))).alias("dim", "value"))
    return out.select(F.lit(series_id).alias("series_id"), "t", "dim", "value")


def read_parquet(spark: SparkSession, path: str, time_col: str | None = None, transpose: bool = False, series_id: str = "s") -> DataFrame:
    """A wide table; transpose: its rows are dimensions and its columns times."""
    df = spark.read.parquet(path)
    out = _in_order(df, [c for c in df.columns if c != time_col], time_col, series_id)
    if transpose:
        out = out.select("series_id", F.col("dim").cast("bigint").alias("t"), F.col("t").cast("int").alias("dim"), "value")
    return out


PLACE = ("_file", "_block", "_at")


def _file_order() -> list:
    """A row's place: its file, the part of the file, and its number in a task, which grows within a part."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]


def _in_order(df: DataFrame, cols: list[str], time_col: str | None, series_id: str) -> DataFrame:
    if time_col:
        return from_wide(df, time_col, cols, series_id)
    return from_wide(numbered(df.select("*", *_file_order()), *PLACE), "t", cols, series_id)


def fill_grid(points: DataFrame, value: float | None = 0.0, chunk: int = 65_536) -> DataFrame:
    """A row for every t from the series' first to its last and every dimension it has; missing cells hold value.

    Times are made in chunks that are dealt out, so no task makes a whole series' times.
    """
    span = points.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.collect_set("dim").alias("dims"))
    part = F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor(F.col("hi") / chunk))).alias("c")
    parts = span.select("series_id", "lo", "hi", "dims", part).repartition("series_id", "c")
    t = F.explode(F.sequence(F.greatest("lo", F.col("c") * chunk), F.least("hi", F.col("c") * chunk + chunk - 1))).alias("t")
    grid = parts.select("series_id", t, "dims").select("series_id", "t", F.explode("dims").alias("dim"))
    return grid.join(points, ["series_id", "t", "dim"], "left").select("series_id", "t", "dim", F.coalesce("value", F.lit(value).cast("double")).alias("value"))


def from_events(spark: SparkSession, sf_dir: str, per: int = 20) -> DataFrame:
    """t: groups of `per` consecutive event ids; dimensions: event types in their order; value: the sum, 0 where there is none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / per).cast("bigint").alias("t"), "event_type", "value")
    return fill_grid(_by_type(events.groupBy("t", "event_type").agg(F.round(F.sum("value"), 2).alias("value")), "event_type"))


def from_event_hours(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """t: hours since the first event's; missing cells hold fill."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint").alias("h"), "event_type", "value")
    first = events.agg(F.min("h").alias("h0"))
    sums = events.groupBy("h", "event_type").agg(F.round(F.sum("value"), 2).alias("value")).join(F.broadcast(first)).select((F.col("h") - F.col("h0")).alias("t"), "event_type", "value")
    return fill_grid(_by_type(sums, "event_type"), fill)


def from_embeddings(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", first)


def _by_type(df: DataFrame, col: str, series_id: str = "s") -> DataFrame:
    kinds = df.select(col).distinct().select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias("dim"))  # one row a dimension
    return df.join(F.broadcast(kinds), col).select(F.lit(series_id).alias("series_id"), "t", "dim", "value")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def append_text(path: str, line: str) -> None:
    """A line to a log on the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(line.rstrip("\n") + "\n")


def share(points: DataFrame, name: str) -> DataFrame:
    """Caches the table and names it for SQL; spark.catalog.uncacheTable(name) lets it go."""
    points.createOrReplaceTempView(name)
    points.sparkSession.catalog.cacheTable(name)
    return points.sparkSession.table(name)
