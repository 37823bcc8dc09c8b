"""Predicates over sets, tags, trims, compactions and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(df: DataFrame, allowed: dict[str, list], frame: Column, frames: list, always: Column) -> DataFrame:
    """Rows of the given frames whose columns hold allowed values, and those that always count."""
    inside = frame.isin(frames)
    for column, values in allowed.items():
        inside = inside & F.col(column).isin(values)
    return df.filter(always | inside)


def first_tag(rules: dict[str, Column], default: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    (name, condition), *rest = rules.items()
    tag = F.when(condition, name)
    for name, condition in rest:
        tag = tag.when(condition, name)
    return tag.otherwise(default)


def trimmed(df: DataFrame, keys: list[str], order: list[str], cut: int) -> DataFrame:
    """Rows without the first and last ``cut`` of each key; a key of at most ``2 x cut`` rows is kept whole.

    Only the ``cut`` rows at either end are ranked: Spark keeps that many of each key in each task before the
    shuffle, so a key with most of the rows doesn't meet in one task.
    """
    if cut <= 0:
        return df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > 2 * cut)
    ends = None
    for order_by in ([F.col(c).asc() for c in order], [F.col(c).desc() for c in order]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
        own = df.select(*keys, *[c for c in order if c not in keys]).withColumn("_nth", nth).filter(F.col("_nth") <= cut).drop("_nth")
        ends = own if ends is None else ends.union(own)
    ends = ends.join(sizes.select(*keys), keys, "left_semi")
    return df.join(ends, list(dict.fromkeys([*keys, *order])), "left_anti")


def compacted(df: DataFrame, keys: list[str], order: str, keep: Column, capacity: int) -> DataFrame:
    """Kept rows with their ``slot`` in order, and whether it lies within the capacity; groups are an image's boxes."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.filter(keep).withColumn("slot", nth).withColumn("stored", F.col("slot") < capacity)


def slots(df: DataFrame, keys: list[str], index: str, keep: Column, value: str, size: int) -> DataFrame:
    """``size`` rows a group: slot i holds row ``index`` = i + 1 if it is kept, else nulls."""
    held = F.when(keep, F.struct(F.col(index).alias("idx"), F.col(value).alias("value")))
    groups = df.groupBy(*keys).agg(*[F.max(F.when(F.col(index) == i + 1, held)).alias(f"_{i}") for i in range(size)])
    return groups.select(*keys, F.posexplode(F.array(*[f"_{i}" for i in range(size)])).alias("slot", "row")).select(*keys, "slot", "row.idx", "row.value")


def best(df: DataFrame, keys: list[str], value: str, index: str) -> DataFrame:
    """The row index of the greatest value of each key, the least index on ties; nulls, NaN and infinities don't count."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.groupBy(*keys).agg(F.max_by(index, F.struct(F.col(value), -F.col(index))).alias(index))


def nearest(df: DataFrame, keys: list[str], value: Column, target: float, index: str) -> DataFrame:
    """The row index of each key whose value is nearest to the target, the least on ties."""
    return df.groupBy(*keys).agg(F.min_by(index, F.struct(F.abs(value - target), F.col(index))).alias(index))
