"""python -m leitmotiv FORMAT PATH WINDOW LOW [HIGH] [options]: motifs of a file as JSON lines, and a line in a log.

FORMAT: csv, text (white space, first column left out), parquet, parquet-t (transposed), tsf, wfdb.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leitmotiv.operators.exact import highlight
from leitmotiv.plans.search import discover, find_motifs_exact, find_motifs_sax
from leitmotiv.sources import points, tsf, wfdb


def read(spark: SparkSession, form: str, path: str, drop: list[str]):
    if form == "csv":
        return points.read_csv(spark, path, drop=tuple(drop))
    if form == "text":
        return points.read_whitespace(spark, path)
    if form == "tsf":
        return tsf.tsf_points(tsf.read_tsf(spark, path)[0])
    if form == "wfdb":
        spark.dataSource.register(wfdb.WfdbSource)
        return spark.read.format("wfdb").load(path)
    return points.read_parquet(spark, path, transpose=form == "parquet-t")


def main(args: list[str] | None = None) -> list[dict]:
    p = argparse.ArgumentParser(prog="leitmotiv", description=__doc__)
    p.add_argument("form", choices=["csv", "text", "parquet", "parquet-t", "tsf", "wfdb"])
    p.add_argument("path")
    p.add_argument("window", type=int)
    p.add_argument("low", type=int)
    p.add_argument("high", type=int, nargs="?")
    p.add_argument("-k", type=int, default=1)
    p.add_argument("-K", type=int, default=8)
    p.add_argument("-L", type=int, default=200)
    p.add_argument("-r", type=float, default=0)
    p.add_argument("--delta", type=float, default=0.01)
    p.add_argument("--noise", type=float, default=0.0)
    p.add_argument("--method", choices=["hash", "exact", "symbols"], default="hash")
    p.add_argument("--segment", type=int, default=8, help="of symbols")
    p.add_argument("--drop", nargs="*", default=[], help="columns of a csv to leave out")
    p.add_argument("--points", help="folder for the points under the motifs, as csv")
    p.add_argument("--log", help="file to append a line to")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    series, high = read(spark, a.form, a.path, a.drop).cache(), a.high or a.low
    if a.method == "hash":
        motifs = discover(series, a.window, a.k, (a.low, high), noise=a.noise, K=a.K, L=a.L, r=a.r, delta=a.delta).motifs
    elif a.method == "exact":
        motifs = find_motifs_exact(series, a.window, a.k, (a.low, high))
    else:
        motifs = find_motifs_sax(series, a.window, a.low, a.segment, k=a.k)
    found = [r.asDict() for r in motifs.collect()]
    for row in found:
        print(json.dumps(row))
    if a.points:
        # A search that doesn't name the series has refused several.
        marked = motifs if "series_id" in motifs.columns else motifs.withColumn("series_id", F.lit(series.agg(F.min("series_id")).first()[0]))
        points.write_csv(highlight(series, marked, a.window), a.points)
    if a.log:
        points.append_text(a.log, json.dumps({"path": a.path, "window": a.window, "low": a.low, "high": high, "motifs": found}))
    return found


if __name__ == "__main__":
    main()
