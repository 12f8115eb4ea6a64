"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), vocabulary(PIECES), keep=["doc_id"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import group_near_duplicates

    return group_near_duplicates(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify_languages

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = fit(docs.where("not held_out and doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    return identify_languages(docs, model, keep=["doc_id", "held_out"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out
    from .toxicity import fit, labelled, score_toxicity

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(labelled(docs.where("not held_out"), _read(spark, sf_dir, "labels")))
    return score_toxicity(docs, model, keep=["doc_id", "held_out"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digest

    return span_digest(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import mark_contamination

    return mark_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), vocabulary(WORDS))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_texts

    return store_texts(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeated_spans

    return remove_repeated_spans(_read(spark, sf_dir, "documents"))


_ALL = (
    op1_token_counts, op2_license_scan, op3_minhash_near_dedup, op4_language_id, op5_toxicity, op6_pii, op7_decontamination, op8_packing, op9_media_columns, op10_substring_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {op3_minhash_near_dedup.__name__: oracles.OP3, op7_decontamination.__name__: oracles.OP7, op10_substring_dedup.__name__: oracles.OP10}
