"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic documents go; one document of each near-duplicate class stays; documents that
hold benchmark passages go; secrets are masked in the texts that remain; what is left
is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm import common, decontamination, near_dedup, packing, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).filter("score < 0.5").select("kept.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not the first (doc_id, text) of their class go; of wholly equal ids and texts one stays."""
    kept = near_dedup.near_classes(docs).filter("kept")
    kept = kept.select(near_dedup.row_key("doc_id", "node").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), near_dedup.text_node("text").alias("_node"))
    other = F.md5(F.to_json("_row"))  # rows of one id and text may differ in other columns: the least by value stays
    rows = rows.select("_row", near_dedup.row_key("_id", "_node").alias("_key"), other.alias("_other")).join(kept, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_other"))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of an item go; rows of one id share the verdict."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, benchmark).select(F.col("doc_id").alias("_found_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))  # no column's name can clash
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_found_id")), "left_anti").select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
