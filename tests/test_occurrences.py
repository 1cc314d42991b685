"""Occurrences without overlap, in an order that does not compare each with all chosen before."""

import numpy as np
from leitmotiv.operators import exact, windows


def test_many_occurrences(spark):
    x, w = np.random.default_rng(6).normal(size=900).round(2), 8
    points = spark.createDataFrame([("s", t, 0, float(v)) for t, v in enumerate(x)], "series_id string, t bigint, dim int, value double")
    motifs = spark.createDataFrame([("s", 1, 100, 300, [0])], "series_id string, rank int, a bigint, b bigint, dims array<int>")
    z = windows.subsequences(points, w)
    out = exact.occurrences(z, motifs, w, 99.0)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapGroups")[0] and "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    of = {r.t: np.array(r.z) for r in z.select("t", "z").collect()}
    far = sorted((float(np.sqrt(((of[t] - of[100]) ** 2).sum())), t) for t in of if abs(t - 100) >= w and abs(t - 300) >= w)
    want = []
    for _, t in far:
        if all(abs(t - u) >= w for u in want):
            want.append(t)
    assert [r.t for r in out.orderBy("distance", "t").collect()] == want
