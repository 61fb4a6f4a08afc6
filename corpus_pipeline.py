"""The corpus pipeline: documents to packed training sequences in five stages, each whole over what the one before kept.

quality: documents that the classifier rejects go. near-dedup: one document of each near-duplicate component stays (five-word shingles, similarity 0.8).
secrets: secrets are masked in the texts. mixing: sources are sampled to their target weights, documents repeated or left out.
packing: what is left becomes sequences of at most 4096 tokens.

A null or empty text has no words: quality scores it by its structure, near-dedup links it with nothing, secrets leave it, and mixing never draws it.
A null doc_id never decides for other rows; a null source is a source of its own. Repeated rows are one near-duplicate group. The smaller id stays; different texts
of that id all do. Without labels of both kinds every document scores the labels' share (0.5 without any), so that all stay or, with bad labels alone, all go. Empty documents give an
empty result. Extra columns stay through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import mixing, near_dedup, packing, quality, secrets
from tidewater.llm.common import stored

SHINGLE = 5
#: The classifier and the draw of the mix cannot be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, _labels(spark, sf_dir)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs, SHINGLE)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.quality_weights(_labels(spark, sf_dir)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near-dedup", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
