"""A corpus in five stages: quality, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leitmotiv.llm import bpe, decontam, linedup, quality, registry, shingles
from leitmotiv.llm.common import materialize, sent


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects: low quality or toxic."""
    return quality.filter_quality(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows. A document that loses all its lines goes; n_chars follows the text."""
    out = linedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose five-word shingle sets link at a Jaccard similarity of 0.8, the document with the smallest id; one row of those that
    repeat id and text.

    Line dedup leaves only scraps of a near copy. So a document counts with its text as it is in docs and, where that was cut, also as in the table of
    documents; what links either links it.
    """
    whole, mark = _table(spark, sf_dir, "documents").select("doc_id", "text"), F.xxhash64("text").alias("h")
    was = whole.select("doc_id", mark).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # Lists of ids are written first, so that the joins that read texts know their size.
    changed = materialize(was.join(docs.select("doc_id", mark), ["doc_id", "h"], "left_anti").select("doc_id").distinct(), "changed")
    # The join reads its texts several times, twice at once: with a table whose row groups are large, two would stand in one executor's memory.
    before = materialize(whole.join(sent(changed), "doc_id", "left_semi"), "before")
    linked = shingles.link_documents(docs.select("doc_id", "text").unionByName(before), size=5, percent=80)
    gone = materialize(linked.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, up to a fifth of its words edited."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(docs, registry.vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
