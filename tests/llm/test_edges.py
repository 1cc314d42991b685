"""Every operator on nulls, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import pytest

import corpus_pipeline
from leitmotiv.llm import bpe, decontam, licenses, linedup, lm, quality, registry, secrets, shingles, urls, vectors

LONG = "one two three four five six seven eight nine ten\n" * 6000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "some text of no document at all"), (4, LONG), (5, "a tie of two rows\nand two\nlines more"),
    (5, "a tie of two rows\nand two\nlines more"), (6, "a tie of two rows\nand two\nlines more"), (7, "ünï ﬁ 日本 \x1f \u2028 <|endoftext|>"), (8, "word"),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, id long, host string, path string, n_lines long, component string, h1 string, w string, score string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 8 else "en", None if i == 4 else "src", len(t or ""), i, "h", "p", 3, "c", "x", "y", "z", "l") for i, t in ROWS]
    return spark.createDataFrame(rows, NAMES).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_licenses(docs, none):
    got = by_id(licenses.scan_licenses(docs))
    assert sum(map(len, got.values())) == len(ROWS) and len(got[5]) == 2
    for k in (1, 2, 3):
        assert (got[k][0]["n_words"], got[k][0]["labels"], got[k][0]["score"], got[k][0]["first_word"]) == (0, "", 0.0, None)
    assert got[4][0]["n_words"] == 60000
    assert licenses.scan_licenses(none).count() == 0


def test_lm(docs, none):
    got = by_id(lm.score_documents(docs))
    assert sum(map(len, got.values())) == len(ROWS) and len(got[5]) == 2
    assert [got[k][0]["n_tokens"] for k in (1, 2, 3)] == [1, 1, 1] and got[4][0]["n_tokens"] == 60001
    assert got[None][0]["held_out"] and lm.score_documents(none).count() == 0


def test_urls(spark):
    rows = [(1, None, "x"), (1, "no scheme", "x"), (2, "http://A.Example.ORG/en/1?x=://y", "x"), (2, "http://A.Example.ORG/en/1?x=://y", "x"), (None, "ftp://org", "x"), (3, "x://" + "a" * 100_000 + ".com/de/", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumnRenamed("host", "_url")
    got = [tuple(r)[:5] for r in urls.filter_urls(df).collect()]
    assert got[0] == (1, "", "", None, "allow") and got[1] == (1, "", "", None, "allow")
    assert got[2] == got[3] == (2, "a.example.org", "/en/1", "example.org/en/1", "block")
    assert got[4] == (None, "org", "", None, "allow") and got[5][3:] == ("com/de/", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_bpe(docs, none):
    got = by_id(bpe.encode_documents(docs, registry.vocabulary(), with_ids=True))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[k][0]["n_tokens"] for k in (1, 2, 3)] == [0, 0, 0] and got[7][0]["ids"][-1] == 49407
    assert got[4][0]["n_tokens"] == 60000 and bpe.encode_documents(none, registry.vocabulary()).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, 600))


def test_secrets(spark, docs, none, forest):
    assert secrets.scan_secrets(docs, forest).count() == 0
    assert secrets.scan_secrets(none, forest).count() == 0
    key = "ab12" * 10
    rows = [(1, f'token = "{key}" and {key} {key}', None, "x"), (1, f'token = "{key}"', "tests/a", "x"), (2, None, None, "x"), (None, "9" * 100_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start string").withColumnRenamed("start", "candidate")
    got = sorted((r["doc_id"] or 0, r["start"], r["length"]) for r in secrets.scan_secrets(df, forest).collect())
    assert got == [(0, 0, 100_000), (1, 9, 40), (1, 9, 40), (1, 55, 40), (1, 96, 40)]


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [], "x"), (5, [0.0, 0.0], "x"), (6, [1.0, None], "x"), (7, [nan, 1.0], "x"), (8, [inf, 1.0], "x"),
        (9, [1.0, 0.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (11, [-1.0, 0.0], "x"), (12, [1e-200, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumnRenamed("label", "h1")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(df).collect())
    assert got == sorted([(0, 0, None, False), (1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)] + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11)])
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_linedup(docs, none):
    out = linedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = by_id(out)
    assert [(got[k][0]["text"], got[k][0]["n_removed"]) for k in (1, 2)] == [(None, 0), ("", 0)]
    assert got[3][0]["text"] == " \n\t " and got[4][0]["n_removed"] == 5999  # the last line is empty, and its windows are single
    assert [r["n_removed"] for r in got[5]] == [0, 0] and (got[6][0]["text"], got[6][0]["n_removed"]) == ("", 3)
    assert linedup.dedup_lines(none).count() == 0


def test_shingles(docs, none):
    got = by_id(shingles.link_documents(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r["n_shingles"], r["component_id"]) for k in (1, 2, 3) for r in got[k]] == [(0, 1), (0, 2), (0, 3)]
    assert got[None][0]["component_id"] is None and [r["component_id"] for r in got[5] + got[6]] == [5, 5, 5]
    assert (got[8][0]["n_shingles"], got[4][0]["n_shingles"]) == (1, 10)
    assert shingles.link_documents(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (99, 0, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.score_quality(docs, labels))
    assert sum(map(len, got.values())) == len(ROWS) and all(0 <= r["posterior"] <= 1 for rs in got.values() for r in rs)
    assert quality.filter_quality(docs, labels).columns == docs.columns
    assert quality.score_quality(none, labels).count() == 0
    kept = quality.score_quality(docs, labels.limit(0))
    assert kept.where("keep").count() == len(ROWS)  # nothing was learned, so nothing is rejected


def test_decontam(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two three four five six"), (3, "two three four five six"), (None, "TIE of two rows, and two lines")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in decontam.find_leaks(docs, items).collect())
    assert got == [(4, 3), (4, 3), (5, 0), (5, 0), (6, 0)]
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, None, 7, 8}
    assert decontam.find_leaks(none, items).count() == 0 and decontam.decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_pipeline_stages(spark, docs, none, tmp_path):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some text of no document at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns, name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 4, 5, 7, 8]
