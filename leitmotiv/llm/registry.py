"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leitmotiv.llm import bpe, decontam, licenses, linedup, lm, quality, secrets, shingles, urls, vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("spans")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"), order=3)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(_read(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.link_documents(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with what they were judged by."""
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).where("keep")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_lm_score": op2_lm_score,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_line_dedup": op7_line_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": urls.oracle_sql(),
    "op6_embedding_neardup": vectors.oracle_sql(),
    "op7_line_dedup": linedup.oracle_sql(),
    "op8_ngram_jaccard": shingles.oracle_sql(),
}
