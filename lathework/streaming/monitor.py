"""Streams of process samples and frames.

The batch forms define the results; the streaming forms keep the same state by key. Event-time
watermarks and late data are an extension: samples that come late by more than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

RATE_SCHEMA = "source string, at double, counter double, rate double, peak double"
_STATE = "at double, counter double, peak double"


def counter_rates(df: DataFrame, key: str, at: str, counter: str, order: list[str] | None = None) -> DataFrame:
    """Rate of a growing counter between samples (0 for the first) and the largest value so far; NaN counts as none."""
    w = Window.partitionBy(key).orderBy(at, *(order or []))
    step = F.col(at) - F.lag(at).over(w)
    rate = F.when(F.lag(at).over(w).isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col(counter) - F.lag(counter).over(w), step), F.lit(0.0))
    )
    peak = F.max(F.nanvl(F.col(counter), F.lit(None).cast("double"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"rate": rate, "peak": peak})


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    at, counter, peak = state.get if state.exists else (None, None, None)
    for pdf in batches:
        rows = []
        for r in pdf.sort_values(["at", "counter"]).itertuples():
            step = None if at is None else r.at - at
            rate = 0.0 if not step else (r.counter - counter) / step
            if r.counter == r.counter:
                peak = r.counter if peak is None else max(peak, r.counter)
            at, counter = r.at, r.counter
            rows.append((key[0], at, counter, rate, peak))
        yield pd.DataFrame(rows, columns=["source", "at", "counter", "rate", "peak"])
    if at is not None:
        state.update((at, counter, peak))


def stream_rates(samples: DataFrame) -> DataFrame:
    """The streaming form over ``source, at, counter``; state is one sample for each source."""
    return samples.groupBy("source").applyInPandasWithState(_advance, RATE_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def stop_above(limit: float, column: str, sink: Callable[[DataFrame, int], None], stop: Callable[[], None]):
    """A ``foreachBatch`` function that writes the batch, then stops the query if a value reaches the limit."""

    def each(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if batch.filter(F.col(column) >= limit).take(1):
            stop()

    return each


def many_sinks(sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str):
    """A ``foreachBatch`` function that appends each sink's rows of a batch below its own folder, once for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        for name, rows in sinks.items():
            rows(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return each


def latest_only(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Drop-oldest: of a batch only the newest row of each key."""
    return batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def after_warmup(frames: DataFrame, sequence: str, warmup: int) -> DataFrame:
    return frames.filter(F.col(sequence) >= warmup)


def require_geometry(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames of another size fail the query."""
    message = F.lit("the frame size changed")
    same = (F.col("width") == width) & (F.col("height") == height)
    return frames.withColumn("width", F.when(same, F.col("width")).otherwise(F.raise_error(message)))


def run_summary(frames: DataFrame, stages: list[str], wall_seconds: float) -> DataFrame:
    """Frames, wall rate, and the rate by summed stage time."""
    total = F.sum(sum((F.col(s) for s in stages[1:]), F.col(stages[0])))
    return frames.agg(
        F.count(F.lit(1)).alias("frames"),
        (F.count(F.lit(1)) / F.lit(wall_seconds)).alias("wall_rate"),
        F.try_divide(F.count(F.lit(1)) * 1000.0, total).alias("effective_rate"),
    )


def windowed(events: DataFrame, at: str, late: str, length: str, slide: str | None = None) -> DataFrame:
    """Extension: counts in event-time windows with a watermark."""
    slot = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(slot).agg(F.count(F.lit(1)).alias("n"))
