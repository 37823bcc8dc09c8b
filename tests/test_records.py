"""Predicates, trims, compactions, units and paths against hand-made cases."""

from pyspark.sql import functions as F

from lathework.functions import scalars, stats
from lathework.operators import compare, selection


def test_trim_keeps_short_keys_whole(spark):
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(4)]
    found = selection.trimmed(spark.createDataFrame(rows, "k string, t long"), ["k"], ["t"], 2).collect()
    assert sorted(map(tuple, found)) == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b (2)", "1,234.5", 2.0, "KB"), ("x", "none", 1.0, "?")], "name string, n string, v double, unit string")
    r = df.select(scalars.without_copy_number(F.col("name")).alias("p"), scalars.flat_path(F.col("name")).alias("f"), scalars.number_with_commas(F.col("n")).alias("n"), scalars.in_bytes(F.col("v"), F.col("unit")).alias("b")).collect()
    assert tuple(r[0]) == ("a/b", "a__b (2)", 1234.5, 2048.0) and tuple(r[1]) == ("x", "x", None, None)


def test_paths_of_nested_columns(spark):
    df = spark.createDataFrame([(1, ("u", [(5,), (6,)])), (2, ("v", None))], "id long, doc struct<name:string,items:array<struct<n:long>>>")
    found = sorted(map(tuple, scalars.flattened(df, "id", "doc").collect()))
    assert found == [(1, "items[0].n", "5"), (1, "items[1].n", "6"), (1, "name", "u"), (2, "name", "v")]


def test_disjunctive_pairs_equal_brute_force(spark):
    rows = [(i, i % 2, (i * 37) % 50, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g long, v long, c long")
    found = {tuple(r) for r in compare.disjunctive_pairs(df, "id", "g", "v", 2, [(F.col("c"), 9)]).collect()}
    expected = {(a[0], b[0], abs(a[2] - b[2])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (abs(a[2] - b[2]) <= 2 or a[3] == b[3] and abs(a[2] - b[2]) <= 9)}
    assert found == expected


def test_slots_picks_and_gates(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, float("nan")), ("a", 3, 7.0)], "k string, idx long, v double")
    slots = selection.slots(df, ["k"], "idx", F.col("v") > 5.5, "v", 4).filter("slot <> 1").orderBy("slot").collect()
    assert [(r.slot, r.idx, r.value) for r in slots] == [(0, None, None), (2, 3, 7.0), (3, None, None)]
    assert selection.best(df, ["k"], "v", "idx").first().idx == 3
    assert selection.nearest(df.filter("not isnan(v)"), ["k"], F.col("v"), 5.9, "idx").first().idx == 1
    assert df.agg(stats.all_equal(F.col("k")).alias("e")).first().e
