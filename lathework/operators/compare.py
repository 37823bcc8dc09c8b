"""Comparison of snapshots, variants and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outer_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """missing, extra, changed or same for each key, with the two sides' values."""
    a = left.select(*keys, F.struct(*values).alias("left"))
    b = right.select(*keys, F.struct(*values).alias("right"))
    state = (
        F.when(F.col("right").isNull(), "missing")
        .when(F.col("left").isNull(), "extra")
        .when(F.col("left") != F.col("right"), "changed")
        .otherwise("same")
    )
    return a.join(b, keys, "full_outer").withColumn("state", state)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, with the side; null keys are orphans."""
    one = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    two = right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return one.union(two)


def key_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_empty(df: DataFrame, message: str) -> DataFrame:
    """``df``, whose first row, if any, fails the query."""
    return df.filter(F.assert_true(F.lit(False), F.lit(message)).isNull())


def paired(df: DataFrame, pair: list[str], variant: str, sides: tuple[str, str], metrics: list[str]) -> DataFrame:
    """One row for each complete pair: both sides' metrics as ``a_`` and ``b_``."""
    found = df.filter(F.col(variant).isin(*sides)).groupBy(*pair).pivot(variant, list(sides)).agg(*[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        renamed = found.toDF(*pair, f"a_{metrics[0]}", f"b_{metrics[0]}")
    else:
        renamed = found.toDF(*pair, *[f"a_{m}" for m in metrics], *[f"b_{m}" for m in metrics])
    return renamed.dropna(subset=[f"{s}_{m}" for s in "ab" for m in metrics])


def wide(df: DataFrame, keys: list[str], name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """Name and value rows as columns, requested names only; the last value by ``order`` wins."""
    return df.groupBy(*keys).pivot(name, names).agg(F.max_by(value, order))


def positional(left: DataFrame, right: DataFrame, order_left: list[Column], order_right: list[Column], keys: list[str]) -> DataFrame:
    """Row i of either side, within ``keys``, after a canonical sort."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_left)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_right)))
    return a.alias("a").join(b.alias("b"), [*keys, "place"], "full_outer")


def profile(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, min, quantiles and max of every numeric column's finite values, a row each; one pass."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") and f.name not in skip]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    kept = long.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    return kept.groupBy("metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.percentile("value", F.lit(0.99)).alias("p99"), F.max("value").alias("max"),
    )


def rewired(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges after two-node bypasses: a removed node's inputs go to its outputs (one level of removal at a time)."""
    gone = removed.select(F.col("node").alias("gone"))
    kept = edges.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti")
    into = edges.join(gone, F.col("target") == F.col("gone")).select("source", "gone")
    out = edges.join(gone, F.col("source") == F.col("gone")).select(F.col("gone").alias("gone2"), "target")
    return kept.select("source", "target").union(into.join(out, F.col("gone") == F.col("gone2")).select("source", "target"))


def variant_pairs(df: DataFrame, variant: str, keys: list[str], value: str) -> DataFrame:
    """Signed and absolute differences of every two variants (a few) that share a key."""
    other = df.select(*keys, F.col(variant).alias("against"), F.col(value).alias("_other"))
    found = df.select(*keys, variant, value).join(other, keys).filter(F.col(variant) < F.col("against"))
    return found.select(*keys, variant, "against", (F.col(value) - F.col("_other")).alias("difference"), F.abs(F.col(value) - F.col("_other")).alias("distance"))


def union_of_keys(sides: list[DataFrame]) -> DataFrame:
    """The distinct keys of all sides, each side reduced before the union."""
    every = sides[0].distinct()
    for side in sides[1:]:
        every = every.union(side.distinct())
    return every.distinct()


def disjunctive_pairs(df: DataFrame, key: str, block: str, value: str, near: int, others: list[tuple[Column, int]]) -> DataFrame:
    """Pairs (a < b) of one block that hold any of several conditions, each an equi-join of its own.

    ``value`` within ``near``: steps of ``near + 1`` meet their own and the next step. ``others``: an equal
    expression and values within a distance.
    """
    rules = [(F.lit(0), near), *others]
    found = None
    for same, distance in rules:
        rows = df.select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(value).alias("v"), same.cast("long").alias("same"))
        step = F.floor(F.col("v") / (distance + 1))
        left = rows.withColumn("step", step)
        right = rows.select(F.col("id").alias("id2"), F.col("block").alias("block2"), F.col("v").alias("v2"), F.col("same").alias("same2"), F.explode(F.array(step - 1, step, step + 1)).alias("step2"))
        on = (F.col("block") == F.col("block2")) & (F.col("same") == F.col("same2")) & (F.col("step") == F.col("step2"))
        pairs = left.join(right, on).filter((F.col("id") < F.col("id2")) & (F.abs(F.col("v") - F.col("v2")) <= distance))
        pairs = pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), F.abs(F.col("v") - F.col("v2")).alias("apart"))
        found = pairs if found is None else found.union(pairs)
    return found.distinct()
