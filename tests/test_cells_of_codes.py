"""Candidates counted in cells, against the joins on codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leitmotiv.operators import distance, lsh, windows
from leitmotiv.plans import queries

P = lsh.Projections(8, 4, 4, 4.0, 7)


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(2).normal(size=(420, 3)).round(2)
    x[60:100] = 2.0  # one bucket holds all of a flat stretch
    return spark.createDataFrame([("s", t, m, float(v)) for t, row in enumerate(x) for m, v in enumerate(row)], "series_id string, t bigint, dim int, value double").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def joined(points, prefix, least_dims):
    return lsh.candidates(lsh.signatures(windows.subsequences(points, 8), P), prefix, least_dims, 8)


def test_candidates(points, monkeypatch):
    monkeypatch.setattr(distance, "SIDE", 1)
    cols = ["l", "a", "b", "n_dims"]
    assert rows(lsh.candidates_in_cells(points, 8, P, 3, 2).select(cols)) == rows(joined(points, 3, 2).select(cols))
    pairs = lambda p: {tuple(r) for r in joined(points, p, 2).select("a", "b").distinct().collect()}
    assert rows(lsh.unseen_in_cells(points, 8, P, 2, 4, 2).select("a", "b")) == sorted(pairs(2) - pairs(4))
    assert rows(lsh.pairs_met(points, 8, P, (2, 3), 2)) == [(p, len(pairs(p))) for p in (2, 3)]
    assert rows(lsh.dims_met(points, 8, P, 3)) == rows(joined(points, 3, 1).groupBy("n_dims").count())


def test_band_candidates(points):
    bands = lsh.minhash_bands(lsh.signatures(windows.subsequences(points, 8), P).withColumn("code", F.slice("code", 1, 2)), 4, 2)
    left, right = bands.withColumnRenamed("t", "a"), bands.withColumnRenamed("t", "b")
    met = left.join(right, ["series_id", "l", "band", "key"]).where("b - a > 8").select("a", "b").distinct()
    assert rows(lsh.minhash_candidates(bands, 8).select("a", "b")) == rows(met)


@pytest.mark.parametrize("name", [
    "lsh_candidates_fullprefix", "lsh_candidates_prefix", "lsh_candidate_dim_counts", "lsh_prefix_anti_join", "lsh_motifs_fixed_d", "lsh_motifs_range_d", "minhash_candidates",
])
def test_no_pair_is_shuffled(spark, sf, name):
    text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any("(a#" in x or "b#" in x for x in text.splitlines() if "Exchange hashpartitioning" in x)
