"""Near duplicates read the table of documents once a job, as two of its row groups may not fit one executor."""

import re

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from leitmotiv.llm import common, shingles


def test_the_join_never_reads_the_table_of_documents(spark, tmp_path, monkeypatch):
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words), " ".join(words), "another text of seven words in all", None]
    table = pa.table({"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    cut = table.set_column(1, "text", pa.array([texts[0], "w7 w8 w9", texts[2], None], pa.string()))
    pq.write_table(cut, tmp_path / "docs.parquet")
    read, real = [], shingles.link_documents

    def link(docs, **options):
        read.extend(docs.inputFiles())
        return real(docs, **options)

    monkeypatch.setattr(shingles, "link_documents", link)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs.parquet")), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    assert any("docs.parquet" in f for f in read) and not any("documents.parquet" in f for f in read)


def test_texts_are_not_shuffled_to_meet_a_short_list_nor_read_twice_at_once(spark, tmp_path, monkeypatch):
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words), " ".join(words[1:]), "another text of seven words in all", " ".join(words), None]
    table = pa.table({"doc_id": pa.array([1, 2, 3, 4, 5], pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(table.set_column(1, "text", pa.array([*texts[:3], "w7 w8 w9", None], pa.string())), tmp_path / "docs.parquet")
    plans, real = {}, common.materialize

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, label)

    monkeypatch.setattr(corpus_pipeline, "materialize", noted)
    monkeypatch.setattr(shingles, "materialize", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        for most in (common.SENT_IDS, 0):  # 0: no list is short
            monkeypatch.setattr(common, "SENT_IDS", most)
            plans.clear()
            left = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs.parquet")), str(tmp_path))
            assert ("SortMergeJoin" in left._jdf.queryExecution().sparkPlan().toString()) == (not most)
            assert all(("SortMergeJoin" in p) == (not most) for p in plans["before"])
            assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5]
            # What isn't written by a step itself has doc_id.
            assert all(len(re.findall(r"ReadSchema: struct<doc_id:bigint,text:string>", p)) <= 2 for ps in plans.values() for p in ps)
            assert plans["links"] and not any("doc_id" in p for p in plans["links"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
