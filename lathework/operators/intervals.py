"""Interval analytics on start and end columns; intervals are half open, empty ones are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (end > low) & (start < high)


def contained(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start >= low) & (end <= high)


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that overlap the window, cut to it."""
    kept = df.filter(overlaps(F.col(start), F.col(end), low, high))
    return kept.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Maximal covered runs of each key; touching intervals join."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.filter(F.col(end) > F.col(start)).withColumn(
        "_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    )
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def busy(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Covered length, span and idle rest of each key."""
    runs = islands(df, keys, start, end)
    return runs.groupBy(*keys).agg(
        F.sum(F.col(end) - F.col(start)).alias("busy"),
        (F.max(end) - F.min(start)).alias("span"),
        (F.max(end) - F.min(start) - F.sum(F.col(end) - F.col(start))).alias("idle"),
    )


def intersection(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Length covered by both sides, by a sweep over the sides' islands; no pair is formed.

    After merging, a side is open at most once, so a point is covered by both where the
    number of open islands is two.
    """
    edges = None
    for side in (left, right):
        runs = islands(side, keys, start, end)
        own = runs.select(*keys, F.col(start).alias("at"), F.lit(1).alias("step")).union(
            runs.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("step"))
        )
        edges = own if edges is None else edges.union(own)
    steps = edges.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("at")
    swept = steps.select(
        *keys,
        F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("open"),
        (F.lead("at").over(order) - F.col("at")).alias("length"),
    )
    return swept.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("open") == 2, F.col("length"))), F.lit(0)).alias("both"))


def containing_frame(events: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_start: str, frame_end: str, carry: list[str]) -> DataFrame:
    """Each event with the disjoint frame that holds it, as-of: one union and one window, no range join."""
    blank = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c not in keys]
    marks = frames.select(*keys, *blank, F.col(frame_start).alias("_at"), F.lit(0).alias("_kind"), F.struct(frame_start, frame_end, *carry).alias("_frame"))
    none = F.lit(None).cast(marks.schema["_frame"].dataType)
    rows = events.select(*keys, *[c for c in events.columns if c not in keys], F.col(at).alias("_at"), F.lit(1).alias("_kind"), none.alias("_frame"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(rows).withColumn("_last", F.last("_frame", ignorenulls=True).over(order)).filter("_kind = 1")
    inside = F.col("_at") < F.col("_last")[frame_end]
    return found.select(*events.columns, F.when(inside, F.col("_last")).alias("frame"))
