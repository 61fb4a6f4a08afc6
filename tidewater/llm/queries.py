"""The thirteen operators as queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, katz, langid, matroska, mixing, near_dedup, packing, quality, secrets, sharding, warc, whitening
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.write(_table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark))).drop("tie")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.shares(_table(spark, sf_dir, "documents"), mixing.quality_weights(_table(spark, sf_dir, "labels")))
    rows = taken.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).withColumn("held_out", remainder("doc_id") == 0)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return katz.score(docs, remainder("doc_id") != 1).withColumn("held_out", remainder("doc_id") == 1)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.components(whitening.whiten(vectors, whitening.fit(vectors)))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.digests(_table(spark, sf_dir, "documents"))
    placed = sharding.interleave(rows, F.col("source"), F.col("shuffled"))
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded = codes.compress(vectors, codes.fit(vectors)).select("row.vec_id", "row.label", "code", "error", "codebooks_sha256")
    fits = {c: F.expr(f"try_cast({c} as long)").alias(c) for c in ("error", "label_error")}
    return codes.with_label_error(coded).select("vec_id", "code", *fits.values(), "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_quality, op3_near_dedup, op4_matroska, op5_secrets, op6_mixing, op7_langid, op8_katz, op9_best_fit_packing, op10_warc, op11_whitening, op12_sharding, op13_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op3_near_dedup": near_dedup.SQL, "op10_warc": warc.SQL, "op12_sharding": sharding.SQL, "op13_codes": codes.SQL}
