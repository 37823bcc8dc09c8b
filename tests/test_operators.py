"""Operators against hand-made cases and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lathework.functions import geometry, hashes, stats, vectors
from lathework.operators import compare, dedup, evaluation, intervals, matching, quality, sampling, similarity

BOX = "g string, idx long, score double, x1 double, y1 double, x2 double, y2 double"


def spans(spark, rows):
    return spark.createDataFrame([("k", s, e) for s, e in rows], "k string, start long, end long")


def test_union_of_intervals(spark):
    found = intervals.busy(spans(spark, [(0, 5), (5, 8), (10, 12), (12, 12)]), ["k"]).first()
    assert (found.busy, found.span, found.idle) == (10, 12, 2)


def test_intersection_of_intervals(spark):
    left, right = spans(spark, [(0, 10)]), spans(spark, [(2, 4), (3, 6), (10, 12)])
    assert intervals.intersection(left, right, ["k"]).first().both == 4


def test_intervals_against_points(spark):
    rng = random.Random(1)
    a = [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 90) for _ in range(20))]
    b = [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 90) for _ in range(20))]
    points = lambda rows: {p for s, e in rows for p in range(s, e)}
    assert intervals.busy(spans(spark, a), ["k"]).first().busy == len(points(a))
    assert intervals.intersection(spans(spark, a), spans(spark, b), ["k"]).first().both == len(points(a) & points(b))
    clipped = intervals.clip(spans(spark, a), F.lit(20), F.lit(50))
    assert intervals.busy(clipped, ["k"]).first().busy == len(points(a) & set(range(20, 50)))


def test_frames_hold_events_as_of(spark):
    events = spark.createDataFrame([("k", 1, 5), ("k", 2, 10), ("k", 3, 25)], "k string, id long, at long")
    frames = spark.createDataFrame([("k", 0, 10, 7), ("k", 10, 20, 8)], "k string, lo long, hi long, n long")
    rows = intervals.containing_frame(events, frames, ["k"], "at", "lo", "hi", ["n"]).collect()
    assert {r.id: r.frame and r.frame.n for r in rows} == {1: 7, 2: 8, 3: None}


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 4, 9)], "x double, one double")
    r = df.agg(stats.quantile(F.col("x"), 0.5).alias("p50"), stats.quantile(F.col("x"), 0.95).alias("p95"), stats.cv_population(F.col("x")).alias("cp"), stats.cv_sample(F.col("x")).alias("cs"), stats.slope(F.col("x"), F.col("one")).alias("slope"), stats.relative_span(F.col("x")).alias("span")).first()
    assert r.p50 == 3.0 and r.p95 == pytest.approx(8.25)
    assert r.cp == pytest.approx(77.0552, abs=1e-4) and r.cs == pytest.approx(88.9757, abs=1e-4)
    assert r.slope == 0.0 and r.span == 8.0
    empty = df.filter("x > 100").agg(*stats.summary(F.col("x")), stats.cv_sample(F.col("x")).alias("cs")).first()
    assert empty["count"] == 0 and empty["median"] is None and empty["cs"] == 0.0


def test_grouped_summary_keeps_no_group_in_memory(spark):
    rows = [("a", float(i % 700)) for i in range(3000)] + [("b", 5.0), ("n", None), (None, 1.0), (None, 4.0)] + [("c", x) for x in (3.0, -1.0, None, 8.5, float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double")
    found = stats.grouped_summary(df, "k", "x")
    close = lambda r: (r[0], *(v if v is None else round(v, 9) for v in r[1:]))
    assert sorted(map(str, map(close, found.collect()))) == sorted(map(str, map(close, df.groupBy("k").agg(*stats.summary(F.col("x"))).collect())))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and stats.grouped_summary(df.limit(0), "k", "x").collect() == []


def test_gates(spark):
    df = spark.createDataFrame([(5.0, 4.0, "min"), (5.0, 4.0, "max"), (None, 4.0, "max")], "v double, l double, d string")
    assert [r[0] for r in df.select(stats.gate(F.col("v"), F.col("l"), F.col("d"))).collect()] == [True, False, False]
    row = spark.range(1).select(stats.improvement(F.lit(110.0), F.lit(100.0), True).alias("a"), stats.improvement(F.lit(110.0), F.lit(100.0), False).alias("b"), stats.envelope(F.lit(3.0), F.lit(3.0), F.lit(4.0), F.lit(True)).alias("c"), stats.energy_per_unit(F.lit(8171.0), F.lit(30.0)).alias("d")).first()
    assert row.a == pytest.approx(10) and row.b == pytest.approx(-10) and row.c and row.d == pytest.approx(0.27237, abs=1e-4)


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v)])
    fit = geometry.letterbox(F.lit(1920), F.lit(1080))
    inner = geometry.unletterbox(box(0, 140, 640, 500), fit, F.lit(1920), F.lit(1080))
    r = spark.range(1).select(
        geometry.iou(box(0, 0, 10, 10), box(5, 5, 15, 15)).alias("iou"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("none"),
        *[v.alias(k) for k, v in fit.items()], *[v.alias(f"u_{k}") for k, v in inner.items()],
        geometry.center_inside(box(0, 0, 2, 2), box(1, 1, 5, 5)).alias("edge"),
    ).first()
    assert r.iou == pytest.approx(25 / 175) and r.none == 0.0 and r.edge
    assert (r.resized_w, r.resized_h, r.left, r.top, r.bottom) == (640, 360, 0, 140, 140)
    assert (r.u_x1, r.u_y1, r.u_x2, r.u_y2) == (0, 0, 1920, 1080)


def test_decode_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.25, 0.1, 0.1], 320.0, 320.0, 100.0, 50.0),
        (1, [0.6, 0.6, 0.6], 320.0, 320.0, 100.0, 50.0),
        (2, [inf, 0.1, 0.1], 320.0, 320.0, 100.0, 50.0),
        (3, [0.9, 0.1, 0.1], nan, 320.0, 100.0, 50.0),
        (4, [0.9, 0.1, 0.1], 320.0, 320.0, 0.0, 50.0),
        (5, [0.9, 0.1, 0.1], -900.0, 320.0, 100.0, 50.0),
        (6, [0.9, nan, 0.1], 320.0, 320.0, 100.0, 50.0),
        (7, [0.0, 0.0, 0.0], 320.0, 320.0, 100.0, 50.0),
    ]
    df = spark.createDataFrame(rows, "id int, scores array<double>, cx double, cy double, w double, h double")
    fit = geometry.letterbox(F.lit(640), F.lit(640))
    kept = {}
    for skip in (True, False):
        out = geometry.decode(F.col("scores"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), fit, F.lit(640), F.lit(640), 0.25, skip)
        found = df.select("id", *[v.alias(k) for k, v in out.items()]).collect()
        kept[skip] = {r.id: (r.class_id, r.x1, r.y1, r.x2, r.y2) for r in found if r.kept}
    assert set(kept[True]) == {0, 1, 6} and set(kept[False]) == {0, 1}
    assert kept[True][1] == (0, 270.0, 295.0, 370.0, 345.0)


def test_hashes(spark):
    values = [3, 5, 4, 4, 9]
    r = spark.createDataFrame([(values, "ffffffffffffffff", "fffffffffffffff0")], "v array<int>, a string, b string").select(
        hashes.adjacent_bits(F.col("v")).alias("bits"),
        hashes.hamming(hashes.from_hex(F.col("a")), hashes.from_hex(F.col("b"))).alias("distance"),
        hashes.to_hex(hashes.from_hex(F.col("b"))).alias("back"),
        hashes.grid_hash(F.array(*[F.lit(x) for x in (1, 2, 1, 5, 5, 6)]), 3).alias("grid"),
        hashes.trailing_number(F.lit("cust#0042")).alias("n"), hashes.trailing_number(F.lit("none")).alias("none"),
    ).first()
    assert r.bits == 0b1001 and r.distance == 4 and r.back == "fffffffffffffff0" and r.grid == 0b1001 and (r.n, r.none) == (42, None)


def test_banded_pairs_are_exact(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    codes = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:5]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, code long")
    found = {(r.a, r.b, r.distance) for r in similarity.banded_pairs(df, "id", "code", 2).collect()}
    expected = {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(codes), 2) if (a ^ b).bit_count() <= 2}
    assert found == expected and len(found) >= 25


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(8, 7), (6, 7), (6, 5), (5, 4), (4, 3), (3, 2), (2, 1), (1, 0), (10, 11)], "a long, b long")
    found = {r.id: r.root for r in similarity.components(nodes, edges, "id").collect()}
    assert found == {**{i: 0 for i in range(9)}, 9: 9, 10: 10, 11: 10}
    sizes = similarity.component_sizes(similarity.components(nodes, edges, "id")).collect()
    assert {r.root: (r.members, r.within) for r in sizes} == {0: (9, False), 9: (1, True), 10: (2, True)}
    assert similarity.components(nodes, edges.limit(0), "id").filter("id <> root").count() == 0


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
    union = area(a) + area(b) - inter
    return inter / union if union else 0.0


def boxes(rng, n, g="g"):
    out = []
    for i in range(n):
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        out.append((g, i, rng.randint(1, 5) / 5, float(x), float(y), float(x + rng.randint(1, 8)), float(y + rng.randint(1, 8))))
    return out


def test_suppression(spark):
    rng = random.Random(2)
    rows = boxes(rng, 30) + boxes(rng, 8, "h")
    found = matching.suppress(spark.createDataFrame(rows, BOX), ["g"], "score", "idx", 0.3).collect()
    expected = {}
    for g in "gh":
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            by = next((k for k in kept if iou(k[3:], r[3:]) > 0.3), None)
            expected[g, r[1]] = by and by[1]
            if by is None:
                kept.append(r)
    assert {(r.g, r.idx): r.suppressed_by for r in found} == expected
    assert all(r.kept == (r.suppressed_by is None) for r in found)
    equal = [("g", i, 0.3, 0.0, 0.0, 4.0, 4.0) for i in range(50)]
    kept = matching.suppress(spark.createDataFrame(equal, BOX), ["g"], "score", "idx", 0.7).filter("kept").collect()
    assert [r.idx for r in kept] == [0]


@pytest.mark.parametrize("ties", ["first", "last"])
def test_greedy_match(spark, ties):
    rng = random.Random(3)
    p, t = boxes(rng, 15), boxes(rng, 15) + [("lone", 0, 1.0, 0.0, 0.0, 1.0, 1.0)]
    p += [("only", 0, 1.0, 0.0, 0.0, 1.0, 1.0)]
    t += [("g", 15, 1.0, *t[0][3:])]
    found = matching.greedy_match(spark.createDataFrame(p, BOX), spark.createDataFrame(t, BOX), ["g"], "score", "idx", 0.2, ties).collect()
    free, expected = {i: r for i, r in enumerate(r for r in t if r[0] == "g")}, set()
    for r in sorted((r for r in p if r[0] == "g"), key=lambda r: (-r[2], r[1])):
        scored = [(iou(r[3:], b[3:]), i) for i, b in sorted(free.items())]
        usable = [s for s in scored if s[0] >= 0.2]
        best = max(usable, key=lambda s: (s[0], s[1] if ties == "last" else -s[1]))[1] if usable else None
        expected.add(("g", r[1], best))
        free.pop(best, None)
    expected |= {("g", None, i) for i in free} | {("only", 0, None), ("lone", None, 0)}
    assert {(r.g, r.prediction, r.target) for r in found} == expected


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        for _ in range(30):
            cost = rng.integers(-5, 6, (n, n)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            own = matching.assign(cost)
            assert sorted(own) == list(range(n)) and cost[range(n), own].sum() == pytest.approx(best)


def test_optimal_match(spark):
    a = [("g", 0, 1.0, 0.0, 0.0, 10.0, 10.0), ("g", 1, 1.0, 20.0, 20.0, 30.0, 30.0), ("far", 0, 1.0, 0.0, 0.0, 10.0, 10.0), ("left", 4, 1.0, 0.0, 0.0, 1.0, 1.0)]
    b = [("g", 0, 1.0, 20.0, 20.0, 30.0, 30.0), ("g", 1, 1.0, 0.0, 0.0, 10.0, 10.0), ("far", 0, 1.0, 9.0, 9.0, 19.0, 19.0), ("right", 5, 1.0, 0.0, 0.0, 1.0, 1.0)]
    found = matching.optimal_match(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["g"], "idx", 0.5).collect()
    assert {(r.g, r.left_index, r.right_index) for r in found} == {("g", 0, 1), ("g", 1, 0), ("far", 0, None), ("far", None, 0), ("left", 4, None), ("right", None, 5)}
    rng = random.Random(9)
    for _ in range(40):
        x, y = (np.array([r[3:] for r in boxes(rng, rng.randint(1, 5))]) for _ in range(2))
        pairs = matching.best_pairs(x, y, 0.2)
        overlap = matching.overlap_matrix(x, y)
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        grid = overlap if len(x) <= len(y) else overlap.T
        best = max(
            (sum(grid[i, p[i]] >= 0.2 for i in range(len(short))), sum(grid[i, p[i]] for i in range(len(short)) if grid[i, p[i]] >= 0.2))
            for p in itertools.permutations(range(len(long)), len(short))
        )
        assert (len(pairs), pytest.approx(sum(o for _, _, o in pairs))) == best


def test_average_precision(spark):
    rng = random.Random(7)
    rows = [(k, rng.random(), rng.randint(0, 1), i) for k in "ab" for i in range(30)] + [("perfect", 0.9, 1, 0)]
    totals = {"a": 40, "b": 30, "perfect": 1, "none": 0}
    df = spark.createDataFrame(rows, "k string, s double, hit int, id long")
    targets = spark.createDataFrame(list(totals.items()), "k string, targets long")
    aps = evaluation.average_precision(df, ["k"], "s", "hit", targets, "id")
    found = {r.k: r.ap for r in aps.collect()}
    for k, n in totals.items():
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[3]))
        hits = np.cumsum([r[2] for r in own]) if own else np.zeros(0)
        precision, recall = hits / np.arange(1, len(own) + 1), hits / max(n, 1)
        if n:
            expected = np.mean([max(precision[recall >= i / 100], default=0.0) for i in range(101)])
            assert found[k] == pytest.approx(expected)
    assert math.isnan(found["none"]) and found["perfect"] == 1.0
    mean = evaluation.mean_average_precision(aps).first()
    assert mean.classes == 3 and mean.map == pytest.approx(np.mean([found[k] for k in ("a", "b", "perfect")]))


def test_threshold_sweep_and_choices(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 1)]
    df = spark.createDataFrame(rows, "s double, hit int")
    swept = evaluation.sweep(df, "s", F.col("hit") == 1, F.count_if(F.col("hit") == 1), [0.1, 0.5, 0.85, 0.95])
    found = {r.threshold: (r.tp, r.fp, r.fn) for r in swept.collect()}
    assert found == {0.1: (3, 1, 0), 0.5: (2, 1, 1), 0.85: (1, 0, 2), 0.95: (0, 0, 3)}
    assert evaluation.best_f1(swept).first().threshold == 0.1
    assert evaluation.nearest_precision(swept, 1.0).first().threshold == 0.85
    grouped = evaluation.regroup(spark.createDataFrame([("tiny", 1, 2), ("small", 3, 4), ("large", 5, 6)], "b string, tp long, fn long"), "b", {"tiny_small": ["tiny", "small"], "medium_large": ["medium", "large"]}, ["tp", "fn"])
    assert {tuple(r) for r in grouped.collect()} == {("tiny_small", 4, 6), ("medium_large", 5, 6)}


def test_label_rules(spark):
    text = "0 1.2 0.5 0.1 0.1\n\n  1 0.5 0.5 0.2 0.2\n1 0.5 0.5 0.2 0.2\n0 0.5\nx 0.5 0.5 0.1 0.1\n0 NaN 0.5 0.1 0.1\n7 0.5 0.5 0.1 0\n"
    lines = quality.label_lines(spark.createDataFrame([("f", text), ("empty", "")], "path string, value string"))
    found = {}
    for r in quality.label_issues(lines, 3).collect():
        found.setdefault(r.line_number, set()).add(r.kind)
    assert found == {
        1: {"center_out_of_range", "box_crosses_image_boundary"}, 3: {"duplicate_box"}, 4: {"token_count"}, 5: {"not_numeric"},
        6: {"not_finite"}, 7: {"class_out_of_range", "size_out_of_range"},
    }
    good = quality.strict(lines.filter("line_number = 2"), 3)
    assert good.first().class_id == 1.0
    with pytest.raises(PySparkException):
        quality.strict(lines.filter("line_number = 1"), 3).collect()


def test_rows_and_groups(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 0)], "g string, i int")
    assert [(r.g, r.i) for r in quality.contiguous(df, ["g"], "i").collect()] == [("a", 3)]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(quality.all_finite(numbers)).collect()] == [True, False, False, False]
    kept, dropped = quality.remap(df, "g", {"a": "A"})
    assert kept.filter("g = 'A'").count() == 3 and [tuple(r) for r in dropped.collect()] == [("b", 1)]
    texts = spark.createDataFrame([(1, "x", "s"), (2, "x", "t"), (3, "y", "s"), (4, None, "s"), (5, None, "s")], "id long, t string, s string")
    groups = dedup.exact_groups(texts, F.col("t"), F.col("id"), F.col("s")).collect()
    assert [(g.group_size, g.cross_split, g.first_member) for g in groups] == [(2, True, 1)]


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "w"), (4, "q")], "k long, v string")
    state = {r.k: r.state for r in compare.outer_diff(a, b, ["k"], ["v"]).collect()}
    assert state == {1: "same", 2: "changed", 3: "missing", 4: "extra"}
    assert {(r.k, r.side) for r in compare.orphans(a, b, "k").collect()} == {(3, "left_only"), (4, "right_only")}
    assert compare.require_empty(a.limit(0), "none").count() == 0
    with pytest.raises(PySparkException):
        compare.require_empty(a, "rows").collect()
    runs = spark.createDataFrame([("f", 1, "v0", 10.0), ("f", 1, "v1", 11.0), ("f", 2, "v0", 9.0)], "s string, pair int, v string, fps double")
    pairs = compare.paired(runs, ["s", "pair"], "v", ("v0", "v1"), ["fps"]).collect()
    assert [(r.a_fps, r.b_fps) for r in pairs] == [(10.0, 11.0)]
    eav = spark.createDataFrame([("k1", "m", 1, "old"), ("k1", "m", 2, "new"), ("k1", "n", 1, "x"), ("k1", "zz", 1, "no")], "k string, name string, o int, value string")
    assert compare.wide(eav, ["k"], "name", "value", "o", ["m", "n"]).first().asDict() == {"k": "k1", "m": "new", "n": "x"}
    zipped = compare.positional(a.withColumn("g", F.lit(1)), b.withColumn("g", F.lit(1)), [F.col("v")], [F.col("v")], ["g"])
    assert zipped.count() == 3
    edges = spark.createDataFrame([("a", "q"), ("q", "b"), ("b", "c")], "source string, target string")
    removed = spark.createDataFrame([("q",)], "node string")
    assert {tuple(r) for r in compare.rewired(edges, removed).collect()} == {("a", "b"), ("b", "c")}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [1.0, 2.0, 5.0]), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0])], "a array<double>, b array<double>")
    found = vectors.errors(F.col("a"), F.col("b"))
    rows = df.select(*[v.alias(k) for k, v in found.items()]).collect()
    assert (rows[0].max_abs, rows[0].mean_abs, rows[0].relative_l2, rows[0].finite) == (3.0, 1.0, 1.0, True)
    assert rows[1].max_abs == float("inf") and not rows[1].same_shape and not rows[2].finite
    q = spark.range(1).select(vectors.quantise(F.lit(0.5), 1.0), vectors.quantise(F.lit(1.5), 1.0), vectors.quantise(F.lit(500.0), 1.0)).first()
    assert tuple(q) == (0.0, 2.0, 127.0)


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "id long, c string")
    first = sampling.per_class(df, ["c"], "id", 5, 1)
    assert first.groupBy("c").count().filter("count = 5").count() == 3
    assert {r.id for r in first.collect()} == {r.id for r in sampling.per_class(df.repartition(7), ["c"], "id", 5, 1).collect()}
    assert sampling.strided(df, ["c"], ["id"], 10).groupBy("c").count().filter("count = 10").count() == 3
    best = sampling.best_of(df, "id", "c", 30, 8, 3).collect()
    assert len(best) == 30 and len({r.candidate for r in best}) == 1
    sizes = {f"g{i}": np.array([10 + i % 7, i % 3, 5]) for i in range(40)}
    split, cost = sampling.assign_groups(sizes, {"train": 0.7, "val": 0.15, "test": 0.15})
    total = sum(v[0] for v in sizes.values())
    for name, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        assert abs(sum(sizes[g][0] for g, s in split.items() if s == name) / total - share) < 0.03
    assert sampling.assign_groups({}, {"train": 1.0}) == ({}, 0.0)


def test_grouped_split_balances_every_language(spark, tmp_path, monkeypatch):
    from lathework.plans import audit

    rows = [(i, f"l{i % 100:02d}", f"text {i}") for i in range(4000)] + [(4000, None, "none")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    monkeypatch.setattr(audit.sampling, "assign_groups", lambda sizes, targets, **k: (seen.update(sizes), ({g: "train" for g in sizes}, 0.0))[1])
    assert audit.grouped_split(spark, str(tmp_path)).count() == 4001
    total = sum(seen.values())
    assert total[0] == 4001 and list(total[1:]) == [40.0] * 100 + [1.0]
