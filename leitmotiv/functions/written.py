"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_WORKSPACE = "/tmp/checkpoints"

_folders: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df from a table written to spark.checkpoint.dir (with a local master a local folder where that is unset): short lineage that survives lost executors.

    The folder goes when the driver's process ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = (base or LOCAL_WORKSPACE).rstrip("/")
    path = f"{base}/leitmotiv/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _folders:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return
