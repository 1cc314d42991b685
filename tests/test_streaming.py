from leitmotiv.config import MotifConfig
from leitmotiv.operators import lsh, topk, windows
from leitmotiv.operators.distance import pack, profile_of_dims
from leitmotiv.sources.points import POINTS
from leitmotiv.streaming.motifs import MotifStream
from test_search import frame, planted


def test_stream_equals_batch(spark, tmp_path):
    """Points in three files, the last of them late ones from the middle."""
    w, points = 20, frame(spark, planted(n=120, dims=3, w=20, at=(15, 80)))
    parts = ["t < 40", "t >= 60", "t >= 40 and t < 60"]
    for k, where in enumerate(parts):
        points.where(where).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    cfg = MotifConfig(window=w, low=2, high=3, k=2, K=4, L=4, r=8)
    stream = MotifStream(spark, str(tmp_path / "store"), cfg, dims=3, prefix=3)
    for k in range(3):
        source = spark.readStream.schema(POINTS).parquet(str(tmp_path / f"in/{k}*"))
        if k == 0:
            query = stream.start(source, checkpointLocation=str(tmp_path / "check"))
            query.processAllAvailable()
            query.stop()
        else:
            stream.process(spark.read.schema(POINTS).parquet(str(tmp_path / f"in/{k}")), k)
    z = windows.subsequences(points, w)
    sig = lsh.signatures(z, lsh.Projections(w, 4, 4, 8, cfg.seed))
    pairs = lsh.candidates(sig, 3, 2, w).select("series_id", "a", "b").distinct()
    found = profile_of_dims(lsh.pair_windows(pairs, pack(z)), 2, 3)
    rows = lambda df: sorted((r["d"], r["rank"], r["a"], r["b"], round(r["distance"], 9)) for r in df.collect())
    want = rows(topk.greedy(topk.top(found, 400, "series_id", "d"), 2, w, "series_id", "d"))
    assert rows(stream.motifs(2)) == want and want[0][2:4] == (15, 80)
    stream.process(spark.read.schema(POINTS).parquet(str(tmp_path / "in/2")), 2)  # the batch again, as after a failure
    assert rows(stream.motifs(2)) == want
