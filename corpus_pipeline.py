"""A training-corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes the documents that the one before it kept, as they were written and
read again, and works on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.decontam import mark_contamination
from siftwell.llm.near_dups import drop_near_duplicates
from siftwell.llm.packing import pack
from siftwell.llm.pii import redact
from siftwell.llm.queries import WORDS, vocabulary
from siftwell.llm.storage import Stages
from siftwell.llm.toxicity import fit, labelled, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier, fitted on the labelled ones, calls toxic."""
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model, clean_only=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates, linked at a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a window of a benchmark item."""
    return mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean_only=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name in the place of personal data; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, vocabulary(WORDS))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express the stages' models; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stages.write(stage(spark, docs, sf_dir))
        if k:
            stages.drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
