"""Top-k with exclusion: pairs by (distance, a, b), skipping a pair that starts within a window of a chosen one's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leitmotiv.functions.written import written

#: spark.sql.optimizer.windowGroupLimitThreshold's default.
RANK_LIMIT, SALT = 1000, 64


def top(pairs: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows by (distance, a, b), overlapping or not. Without `by`, a bounded top-n in every task and one merge.

    Spark cuts a ranking short within each task for up to RANK_LIMIT rows only; beyond, the rows of a group are dealt over SALT parts, ranked there
    and then together, so that no task sorts more of a group than its part or SALT * k rows.
    """
    if not by:
        return pairs.orderBy("distance", "a", "b").limit(k)
    from pyspark.sql import Window

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "a", "b"))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")

    if k > RANK_LIMIT:
        pairs = ranked(pairs.withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALT))), *by, "_salt").drop("_salt")
    return ranked(pairs, *by)


def overlaps(p: Column, q: Column, window: int) -> Column:
    gaps = [F.abs(p[x] - q[y]) < window for x in ("a", "b") for y in ("a", "b")]
    return gaps[0] | gaps[1] | gaps[2] | gaps[3]


def greedy(candidates: DataFrame, k: int, window: int, *by: str) -> DataFrame:
    """rank, and the columns of candidates, of the pairs chosen in order. candidates: a bounded list (in each group of by)."""
    kept = [c for c in candidates.columns if c not in ("distance", "a", "b", *by)]
    item = F.struct("distance", "a", "b", *kept)
    kind = candidates.select(item.alias("x")).schema["x"].dataType.simpleString()
    grouped = candidates.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    chosen = F.aggregate(
        "_all",
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda y: overlaps(x, y, window)), F.concat(acc, F.array(x))).otherwise(acc),
    )
    out = grouped.select(*by, F.posexplode(chosen).alias("_pos", "_x"))
    return out.select(*by, (F.col("_pos") + 1).alias("rank"), *[F.col(f"_x.{c}").alias(c) for c in ("a", "b", "distance", *kept)])


def choose(candidates: DataFrame, k: int, window: int, *by: str) -> DataFrame:
    """As greedy, over candidates of any number: one grouped minimum for each rank, past what overlaps the pairs chosen before.

    The candidates are read k times, so they should be a written table.
    """
    kept = [c for c in candidates.columns if c not in ("distance", "a", "b", *by)]
    item = F.struct("distance", "a", "b", *kept).alias("_x")
    chosen = None
    for rank in range(1, k + 1):
        left = candidates
        if chosen is not None:
            taken = chosen.groupBy(*by).agg(F.collect_list(F.struct("_x.a", "_x.b")).alias("_taken"))  # at most k a group
            left = candidates.join(F.broadcast(taken), list(by)).where(~F.exists("_taken", lambda y: overlaps(F.struct("a", "b"), y, window)))
        best = written(left.groupBy(*by).agg(F.min(item).alias("_x")).withColumn("rank", F.lit(rank)), "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
        if best.isEmpty():
            break
    return chosen.select(*by, "rank", *[F.col(f"_x.{c}").alias(c) for c in ("a", "b", "distance", *kept)])
