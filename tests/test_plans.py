"""What the physical plans may and may not hold."""

import re

import pytest

from leitmotiv.operators import distance, lsh, windows
from leitmotiv.operators.distance import pair_distances
from leitmotiv.plans import queries
from leitmotiv.sources import points as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["points_events", "window_stats", "lsh_candidates_fullprefix", "sax_collision_counts", "recall_summary", "group_mean", "max_normalised", "left_join_metrics"])
def test_no_nested_loops(spark, sf, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(queries.QUERIES[name](spark, sf)))


def test_scans_read_what_they_need(spark, sf):
    schemas = set(re.findall(r"ReadSchema: struct<(.*?)>", plan(src.from_events(spark, sf))))
    assert {c.split(":")[0] for s in schemas for c in s.split(",")} <= {"event_id", "event_type", "value"}
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'"))


def test_statistics_stay_native(spark, sf):
    points = src.from_events(spark, sf)
    for df in (windows.window_stats(points, 8), windows.subsequences(points, 8), windows.moving_average(points, 2), windows.impute_mean(points)):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_pairs_meet_in_cells(spark, sf):
    text = plan(pair_distances(src.from_events(spark, sf), 8))
    assert "FlatMapGroupsInArrow" in text and "NestedLoop" not in text


def test_cells_shuffle_points_not_windows(spark):
    n, d, w = 300_000, 2, 200
    points = spark.range(n * d).selectExpr("'s' as series_id", f"id % {n} as t", f"cast(id div {n} as int) as dim", "rand(1) as value")
    size, cells, numbers = distance.chunks(points, w).selectExpr("max(size)", "sum(last - first + 1)", "sum((last - first + 1) * size(values))").first()
    assert size == distance.LARGEST and cells == (-(-n // size)) ** 2
    assert numbers <= 2 * n * d * -(-n // size)


def test_candidates_join_on_keys(spark, sf):
    sig = lsh.signatures(windows.subsequences(src.from_events(spark, sf), 8), lsh.Projections(8, 4, 4, 4.0, 7))
    assert re.search(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[series_id#\d+, dim#\d+, l#\d+, key#\d+\]", plan(lsh.candidates(sig, 4, 2, 8)))
