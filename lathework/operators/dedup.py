"""Exact duplicate grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_groups(df: DataFrame, content: Column, member: Column, split: Column) -> DataFrame:
    """One row for each content that occurs at least twice.

    Members are pre-aggregated before the shuffle, so a content that holds a
    third of all rows costs one row for each task. Null content joins no group.
    """
    keyed = df.select(F.sha2(content, 256).alias("sha256"), member.alias("_m"), split.alias("_s"))
    return (
        keyed.filter(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            (F.min("_s") != F.max("_s")).alias("cross_split"),
            F.min("_m").alias("first_member"),
        )
        .filter("group_size >= 2")
    )


def numbered(groups: DataFrame, by: str, pattern: str, name: str) -> DataFrame:
    """``groups`` with an ordinal in the order of ``by``, distributed.

    Rows are ranked within 256 ranges of the key's first byte, and the ranges' sizes (256 rows) give each its start.
    """
    lead = F.substring(F.col(by), 1, 2)
    ranked = groups.withColumn("_range", lead).withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(by)))
    sizes = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"))
    placed = ranked.join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.format_string(pattern, F.col("_start") + F.col("_rank"))).drop("_range", "_rank", "_start")
