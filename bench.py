"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: the tables, BENCH_CPUS: local cores."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leitmotiv.config import MotifConfig
from leitmotiv.operators import exact, lsh, windows
from leitmotiv.plans import search
from leitmotiv.plans.queries import QUERIES
from leitmotiv.sources import points as src
from leitmotiv.sources import synthetic

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def find(points, **options):
    return search.find_motifs(points, MotifConfig(**{"k": 1, "L": 200} | options)).motifs.collect()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = src.from_events(spark, SF).cache()
    events.count()
    embeddings = src.from_embeddings(spark, SF, 8).cache()  # 8 of the components, as in earlier rounds
    embeddings.count()
    planted = {n: synthetic.planted(spark, n, 5, 200, 2, (n // 10, n // 2)).cache() for n in (10_000, 100_000, 1_000_000)}
    for p in planted.values():
        p.count()
    count = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).collect()  # noqa: E731  reads every column
    queries = {
        "motifs_hashed_events": lambda: find(events, window=50, low=2, high=2, r=8),
        "motifs_hashed_range_events": lambda: find(events, window=50, low=2, high=4, r=8),
        "motifs_hashed_embeddings": lambda: find(embeddings, window=50, low=3, high=3, r=8),
        "motifs_hashed_planted_10k": lambda: find(planted[10_000], window=200, low=2, high=2),
        "motifs_hashed_planted_100k": lambda: find(planted[100_000], window=200, low=2, high=2),
        "motifs_hashed_planted_1m": lambda: find(planted[1_000_000], window=200, low=2, high=2),
        "motifs_exact_events": lambda: exact.exact_motifs(events, 8, 2, 2, 3).collect(),
        "matrix_profile_embeddings": lambda: count(exact.matrix_profile(embeddings, 8, 2, 2)),
        "motifs_symbols_events": lambda: search.find_motifs_sax(events, 16, 2, 2, 6).collect(),
        "signatures_events": lambda: count(lsh.signatures(windows.subsequences(events, 50), lsh.Projections(50, 8, 20, 8.0, 7))),
        "points_events": lambda: count(QUERIES["points_events"](spark, SF)),
        "window_stats": lambda: count(QUERIES["window_stats"](spark, SF)),
        "window_znorm": lambda: count(QUERIES["window_znorm"](spark, SF)),
        "sax_words": lambda: count(QUERIES["sax_words"](spark, SF)),
        "lsh_tensored_codes": lambda: count(QUERIES["lsh_tensored_codes"](spark, SF)),
        "recall_summary": lambda: count(QUERIES["recall_summary"](spark, SF)),
    }
    find(events, window=8, low=2, high=2, r=8, L=8, batch=8)  # starts the workers and compiles code
    times = {}
    for name, run in queries.items():
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
