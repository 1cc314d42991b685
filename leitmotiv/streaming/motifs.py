"""Motifs over a stream of points, kept up to date batch by batch.

A batch of points completes windows: those that hold one of its points and now have all their points. Only these are hashed; they meet the
signatures of all windows so far in an equi-join, and their candidates compete with all pairs so far. Points may come late and in any order,
as a window is complete whenever its last point comes.

The store holds a folder for each batch (points, signatures, windows, measured pairs). A batch that Spark repeats after a failure writes its
folders anew, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leitmotiv.config import MotifConfig
from leitmotiv.functions.written import written
from leitmotiv.operators import lsh
from leitmotiv.operators.distance import pack, profile_of_dims
from leitmotiv.operators.topk import choose
from leitmotiv.operators.windows import subsequences
from leitmotiv.sources.points import POINTS


class MotifStream:
    """cfg.r must be given. prefix: how many codes must agree (cfg.K unless given). dims: dimensions of the series."""

    def __init__(self, spark: SparkSession, store: str, cfg: MotifConfig, dims: int, prefix: int | None = None) -> None:
        if not cfg.r:
            raise ValueError("a stream needs a bin width")
        self.spark, self.store, self.cfg, self.dims = spark, store.rstrip("/"), cfg, dims
        self.prefix = prefix or cfg.K
        self.projections = lsh.Projections(cfg.window, cfg.K, cfg.L, cfg.r, cfg.seed)

    def start(self, points: DataFrame, **options: str) -> StreamingQuery:
        """points: a stream with the columns of POINTS; options: of writeStream (checkpointLocation and others)."""
        return points.writeStream.options(**options).foreachBatch(self.process).start()

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.store}/{table}/batch={batch}")

    def _get(self, table: str, batch: int) -> DataFrame:
        """The table as of a batch; folders of later ones don't count."""
        return self.spark.read.parquet(f"{self.store}/{table}").where(F.col("batch") <= batch).drop("batch")

    def process(self, batch: DataFrame, number: int) -> None:
        w = self.cfg.window
        new = batch.select(*POINTS.names).dropDuplicates(["series_id", "t", "dim"])
        self._put(new, "points", number)
        new = self.spark.read.schema(POINTS).parquet(f"{self.store}/points/batch={number}")
        touched = new.select("series_id", F.explode(F.sequence(F.col("t") - w + 1, F.col("t"))).alias("t")).distinct()
        span = touched.groupBy("series_id").agg(F.min("t").alias("lo"), (F.max("t") + w - 1).alias("hi"))
        near = self._get("points", number).join(F.broadcast(span), "series_id").where(F.col("t").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")  # one row a series
        z = subsequences(near.dropDuplicates(["series_id", "t", "dim"]), w).join(touched, ["series_id", "t"], "left_semi")
        self._put(z.select("series_id", "t", "dim", "z"), "z", number)
        z = self.spark.read.parquet(f"{self.store}/z/batch={number}")
        self._put(lsh.signatures(z, self.projections), "sig", number)
        self._put(profile_of_dims(self._pairs(number), self.cfg.low, self.cfg.high), "best", number)

    def _pairs(self, number: int) -> DataFrame:
        """Candidate pairs with a window of this batch, measured."""
        cut = lambda df: df.select("series_id", "dim", "l", "t", F.slice("code", 1, self.prefix).alias("key"))
        new = cut(self.spark.read.parquet(f"{self.store}/sig/batch={number}")).withColumnRenamed("t", "x")
        met = new.join(cut(self._get("sig", number)).withColumnRenamed("t", "y"), ["series_id", "dim", "l", "key"]).where(F.abs(F.col("x") - F.col("y")) > self.cfg.window)
        a, b = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        agreed = met.select("series_id", "l", a, b, "dim").groupBy("series_id", "l", "a", "b").agg(F.count_distinct("dim").alias("n")).where(F.col("n") >= self.cfg.low)
        pairs = written(agreed.select("series_id", "a", "b").distinct(), "pairs")
        ends = pairs.select("series_id", F.explode(F.array("a", "b")).alias("t")).distinct()
        whole = pack(self._get("z", number).join(ends, ["series_id", "t"], "left_semi")).where(F.size("z") == self.dims)
        return lsh.pair_windows(pairs, whole)

    def _best(self, number: int) -> DataFrame:
        empty = self.spark.createDataFrame([], "series_id string, a bigint, b bigint, d int, distance double, dims array<int>, dim_dists array<double>")
        if number < 0:
            return empty
        return self._get("best", number).select(empty.columns)

    def motifs(self, number: int) -> DataFrame:
        """series_id, d, rank, a, b, distance, dims, dim_dists after a batch."""
        return choose(self._best(number), self.cfg.k, self.cfg.window, "series_id", "d")
