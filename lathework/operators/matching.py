"""Suppression and matching of boxes inside a group, and the assignment solver.

Groups (boxes of one image and class) are folded in one row each; a fold is sequential, so a
group must fit a task, as detections of an image do. Grouping keys spread the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lathework.functions import geometry

_CORNERS = ("x1", "y1", "x2", "y2")


def suppress(boxes: DataFrame, keys: list[str], score: str, index: str, threshold: float) -> DataFrame:
    """Greedy suppression with a trace.

    Boxes go by descending score, then index; a box is dropped if it overlaps a kept one by
    more than ``threshold`` (strictly). Returns the boxes with ``kept``, and for dropped ones the
    first kept box that suppressed them and the overlap.
    """
    order = F.struct((-F.col(score)).alias("order"), F.col(index).alias("index"), *[F.col(c).cast("double").alias(c) for c in _CORNERS], F.col(score).alias("score"))
    groups = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("boxes"))
    element = groups.schema["boxes"].dataType.elementType
    kind = f"struct<kept:array<{element.simpleString()}>,trace:array<struct<index:{element['index'].dataType.simpleString()},by:{element['index'].dataType.simpleString()},overlap:double>>>"

    def step(acc: Column, box: Column) -> Column:
        hits = F.filter(
            F.transform(acc["kept"], lambda k: F.struct(k["index"].alias("by"), geometry.iou(k, box).alias("overlap"))),
            lambda h: h["overlap"] > threshold,
        )
        by = F.get(hits, F.lit(0))
        return F.struct(
            F.when(F.size(hits) == 0, F.concat(acc["kept"], F.array(box))).otherwise(acc["kept"]).alias("kept"),
            F.concat(acc["trace"], F.array(F.struct(box["index"].alias("index"), by["by"].alias("by"), by["overlap"].alias("overlap")))).alias("trace"),
        ).cast(kind)

    empty = F.struct(F.array().alias("kept"), F.array().alias("trace")).cast(kind)
    folded = groups.select(*keys, "boxes", F.aggregate("boxes", empty, step).alias("out"))
    rows = folded.select(*keys, F.explode(F.arrays_zip("boxes", F.col("out.trace").alias("trace"))).alias("z"))
    return rows.select(
        *keys,
        F.col("z.boxes.index").alias(index),
        F.col("z.boxes.score").alias(score),
        *[F.col(f"z.boxes.{c}").alias(c) for c in _CORNERS],
        F.col("z.trace.by").isNull().alias("kept"),
        F.col("z.trace.by").alias("suppressed_by"),
        F.col("z.trace.overlap").alias("overlap"),
    )


def greedy_match(predictions: DataFrame, targets: DataFrame, keys: list[str], score: str, index: str, threshold: float, ties: str = "first") -> DataFrame:
    """Predictions by descending score, then index, each take the best free target of their group.

    The best target has the greatest overlap, of at least ``threshold`` and above 0; of equal ones the first or,
    with ``ties="last"``, the last by index. Returns every prediction with its target or null,
    and every target left over with a null prediction.
    """
    box = lambda: F.struct(F.col(index).alias("index"), *[F.col(c).cast("double").alias(c) for c in _CORNERS])
    own = predictions.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("order"), F.col(index).alias("index"), *[F.col(c).cast("double").alias(c) for c in _CORNERS]))).alias("own")
    )
    free = targets.groupBy(*keys).agg(F.sort_array(F.collect_list(box())).alias("free"))
    groups = own.join(free, keys, "full_outer").select(
        *keys, F.coalesce("own", F.array().cast(own.schema["own"].dataType)).alias("own"), F.coalesce("free", F.array().cast(free.schema["free"].dataType)).alias("free")
    )
    number = free.schema["free"].dataType.elementType["index"].dataType.simpleString()
    kind = f"struct<free:{free.schema['free'].dataType.simpleString()},pairs:array<struct<prediction:{number},target:{number},overlap:double>>>"

    def step(acc: Column, p: Column) -> Column:
        scored = F.transform(acc["free"], lambda t: F.struct(geometry.iou(p, t).alias("overlap"), t["index"].alias("index")))
        usable = F.filter(scored, lambda s: (s["overlap"] >= threshold) & (s["overlap"] > 0))
        top = F.array_max(F.transform(usable, lambda s: s["overlap"]))
        best = F.filter(usable, lambda s: s["overlap"] == top)
        chosen = F.element_at(best, F.lit(1 if ties == "first" else -1))
        target = F.when(F.size(best) > 0, chosen["index"])
        return F.struct(
            F.filter(acc["free"], lambda t: target.isNull() | (t["index"] != target)).alias("free"),
            F.concat(acc["pairs"], F.array(F.struct(p["index"].alias("prediction"), target.alias("target"), F.when(F.size(best) > 0, chosen["overlap"]).alias("overlap")))).alias("pairs"),
        ).cast(kind)

    start = F.struct(F.col("free").alias("free"), F.array().alias("pairs")).cast(kind)
    folded = groups.select(*keys, F.aggregate("own", start, step).alias("out"))
    rest = F.transform(F.col("out.free"), lambda t: F.struct(F.lit(None).cast(number).alias("prediction"), t["index"].alias("target"), F.lit(None).cast("double").alias("overlap")))
    every = F.concat(F.col("out.pairs"), rest)
    return folded.select(*keys, F.explode(every).alias("m")).select(*keys, "m.prediction", "m.target", "m.overlap")


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (shortest augmenting paths with potentials).

    The matrix may have more columns than rows.
    """
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        shortest, via = np.full(m, np.inf), np.full(m, -1)
        seen = np.zeros(m, bool)
        row, so_far, end = start, 0.0, -1
        while end < 0:
            reach = so_far + cost[row] - row_price[row] - col_price
            closer = ~seen & (reach < shortest)
            shortest[closer], via[closer] = reach[closer], row
            col = int(np.where(seen, np.inf, shortest).argmin())
            so_far, seen[col] = shortest[col], True
            if row_of[col] < 0:
                end = col
            else:
                row = row_of[col]
        done = seen.copy()
        done[end] = False
        col_price[done] += shortest[done] - so_far
        row_price[start] += so_far
        for c in np.flatnonzero(done):
            row_price[row_of[c]] += so_far - shortest[c]
        while True:
            row = via[end]
            row_of[end], before = row, np.flatnonzero(row_of == row)
            before = [c for c in before if c != end]
            if row == start:
                break
            end = int(before[0])
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def overlap_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def best_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """The most pairs of overlap at least ``threshold``, then the greatest total overlap."""
    if not len(a) or not len(b):
        return []
    overlap = overlap_matrix(a, b)
    if min(len(a), len(b)) == 1:  # one box on a side takes its best partner
        i, j = np.unravel_index(overlap.argmax(), overlap.shape)
        return [(int(i), int(j), float(overlap[i, j]))] if overlap[i, j] >= threshold else []
    size = max(len(a), len(b))
    cost = np.zeros((size, size))
    cost[: len(a), : len(b)] = np.where(overlap >= threshold, -(1000.0 + overlap), 0.0)
    return [(i, int(j), float(overlap[i, j])) for i, j in enumerate(assign(cost)[: len(a)]) if j < len(b) and overlap[i, j] >= threshold]


def _paired(threshold: float):
    """Pairs and leftovers of many groups, a row each, whose sides are lists of (index, corners)."""

    def scan(batches):
        for batch in batches:
            number, out = [], ([], [], [])
            sides = [_flat(batch.column(k)) for k in (1, 2)]
            for g in range(batch.num_rows):
                (x, a), (y, b) = ((index[lo:hi], boxes[lo:hi]) for index, boxes, ends in sides for lo, hi in [ends[g : g + 2]])
                found = best_pairs(a, b, threshold)
                used_a, used_b = {i for i, _, _ in found}, {j for _, j, _ in found}
                rows = [(int(x[i]), int(y[j]), o) for i, j, o in found]
                rows += [(int(x[i]), None, None) for i in range(len(x)) if i not in used_a]
                rows += [(None, int(y[j]), None) for j in range(len(y)) if j not in used_b]
                number += [g] * len(rows)
                for column, values in zip(out, zip(*rows)):
                    column.extend(values)
            columns = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(number, pa.int64())), *columns], ["group", "left_index", "right_index", "overlap"]
            )

    return scan


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All indexes and corners of a list column, and where each row's begin."""
    rows = column.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    corners = np.column_stack([np.asarray(rows.field(c).cast(pa.float64())) for c in _CORNERS]) if len(rows) else np.empty((0, 4))
    return np.asarray(rows.field("index").cast(pa.int64())), corners, np.concatenate([[0], np.cumsum(sizes)])


def optimal_match(left: DataFrame, right: DataFrame, keys: list[str], index: str, threshold: float) -> DataFrame:
    """Optimal one-to-one pairs of each group, and both sides' leftovers with nulls.

    The most pairs that overlap by ``threshold`` or more, of these the greatest total overlap. Each
    group's boxes are collected in order of their index, and whole batches of groups are solved at a time.
    """
    box = F.struct(F.col(index).cast("long").alias("index"), *[F.col(c).cast("double").alias(c) for c in _CORNERS])
    tagged = left.select(*keys, box.alias("box"), F.lit(True).alias("first")).union(right.select(*keys, box.alias("box"), F.lit(False).alias("first")))
    side = lambda which: F.sort_array(F.collect_list(F.when(F.col("first") == which, F.col("box"))))
    groups = tagged.groupBy(*keys).agg(side(True).alias("a"), side(False).alias("b"))
    rows = groups.select(F.struct(*keys).alias("group"), "a", "b")
    schema = StructType().add("group", rows.schema["group"].dataType).add("left_index", "long").add("right_index", "long").add("overlap", "double")
    return rows.mapInArrow(_paired(threshold), schema).select("group.*", "left_index", "right_index", "overlap")
