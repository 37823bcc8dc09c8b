"""Statistics as aggregate and scalar column expressions, all null-safe and ANSI-safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a summary, in order.
SUMMARY = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
TIMING = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def quantile(x: Column, q: float) -> Column:
    """Exact quantile by linear interpolation."""
    return F.percentile(x, F.lit(q))


def summary(x: Column) -> list[Column]:
    """count, min, quantiles, max and mean; of no values a count of 0 and nulls."""
    return [
        F.count(x).alias("count"),
        F.min(x).alias("min"),
        *[quantile(x, q).alias(n) for n, q in SUMMARY.items()],
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
    ]


def grouped_summary(df: DataFrame, key: str, x: str) -> DataFrame:
    """``summary`` of ``x`` for each ``key``, without a group's values in memory.

    Values are counted first. Approximate cuts split them into ranges, so that a large
    group is sorted by many tasks; ranks are exact wherever the cuts fall.
    """
    counts = df.groupBy(F.col(key).alias("_k"), F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = df.groupBy(F.col(key).alias("_c")).agg(F.percentile_approx(x, [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    ranged = counts.filter("_x IS NOT NULL").join(F.broadcast(cuts), F.col("_k").eqNullSafe(F.col("_c")))  # broadcast: a row for each key
    ranged = ranged.select("_k", "_x", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_r"))
    sizes = ranged.groupBy(F.col("_k").alias("_c"), F.col("_r").alias("_s")).agg(F.sum("_n").alias("_n"))
    by_key = Window.partitionBy("_c")
    sizes = sizes.select("_c", "_s", (F.sum("_n").over(by_key.orderBy("_s")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_key).alias("_all"))
    ranks = ranged.join(F.broadcast(sizes), F.col("_k").eqNullSafe(F.col("_c")) & (F.col("_r") == F.col("_s")))  # broadcast: 64 rows for each key
    ranks = ranks.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_r").orderBy("_x"))).withColumn("_from", F.col("_to") - F.col("_n"))

    def at(q: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(q)
        held = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_x")))
        low, high, part = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    quantiles = ranks.groupBy("_k").agg(*[at(q).alias(n) for n, q in SUMMARY.items()])
    rest = df.groupBy(key).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    return rest.join(quantiles, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "count", "min", *SUMMARY, "max", "mean")


def timing(x: Column) -> list[Column]:
    return [
        F.count(x).alias("count"),
        F.sum(x).alias("total"),
        F.avg(x).alias("mean"),
        *[quantile(x, q).alias(n) for n, q in TIMING.items()],
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]


def cv_population(x: Column) -> Column:
    """Coefficient of variation in percent, by the population deviation."""
    return F.try_divide(F.stddev_pop(x), F.avg(x)) * 100


def cv_sample(x: Column) -> Column:
    """By the sample deviation; 0 of fewer than two values or a mean of 0."""
    return F.when((F.count(x) < 2) | (F.avg(x) == 0), F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(x), F.avg(x)) * 100)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 of fewer than two points or of one x."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def relative_span(x: Column) -> Column:
    return F.try_divide(F.max(x) - F.min(x), F.min(x))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def improvement(final: Column, baseline: Column, higher_is_better: bool) -> Column:
    """Percent by which ``final`` is better than ``baseline``."""
    change = F.try_divide(final - baseline, baseline) * 100
    return change if higher_is_better else -change


def reduction(after: Column, before: Column) -> Column:
    return 1 - F.try_divide(after, before)


def energy_per_unit(mean_milliwatts: Column, units_per_second: Column) -> Column:
    """Joules for each unit of work."""
    return F.try_divide(mean_milliwatts / 1000, units_per_second)


def gate(value: Column, limit: Column, direction: Column) -> Column:
    """Whether a metric holds its limit: ``min`` (at least) or ``max`` (at most); nulls fail."""
    return F.coalesce(F.when(direction == "min", value >= limit).otherwise(value <= limit), F.lit(False))


def envelope(candidate: Column, low: Column, high: Column, higher_is_better: Column) -> Column:
    """Whether the candidate is within the baselines' range on its bad side."""
    return F.when(higher_is_better, candidate >= low - 1e-12).otherwise(candidate <= high)


def all_equal(x: Column) -> Column:
    """Whether all values are the same; nulls don't count, and no value is equal."""
    return F.coalesce(F.min(x) == F.max(x), F.lit(True))


def per_frame(df: DataFrame, keys: list[str], frame: str, value: str, frames: int) -> DataFrame:
    """Totals of each group, its number of frames, and its totals and calls for each of ``frames`` frames of the run."""
    by_frame = df.groupBy(*keys, frame).agg(F.sum(value).alias("q"), F.count(F.lit(1)).alias("n"))
    return by_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("q").alias("total"), (F.sum("q") / float(frames)).alias("per_frame"), (F.sum("n") / float(frames)).alias("calls_per_frame")
    )
