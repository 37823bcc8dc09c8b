"""Readers, writers and streams."""

import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lathework.sources import files
from lathework.streaming import monitor


def test_listing_and_contents(spark, tmp_path):
    for name in ("a/b.JPG", "a/.hidden/c.png", "a/d.txt", "a/e.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.collect()}
    assert names(files.listing(spark, str(tmp_path / "a"))) == {"b.JPG", "e.png"}
    assert names(files.listing(spark, str(tmp_path / "a"), hidden=True)) >= {"b.JPG", "e.png"}
    assert files.newest(files.listing(spark, str(tmp_path / "a"), ("txt",)), "d.txt").first().folder.endswith("/a")
    assert files.whole_texts(spark, str(tmp_path / "a")).first().value == "a/d.txt"
    assert files.contents(spark, str(tmp_path / "a"), "*.txt").first().sha256


def test_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿image,score\n1,\"1,234.5\"\n".encode())
    rows = files.require(files.csv(spark, str(tmp_path / "x.csv")), ["frame_index", "candidate_index"], {"frame_index": "image"}, {"candidate_index": -1})
    r = rows.withColumn("score", files.plain_number(F.col("score"))).first()
    assert (r.frame_index, r.candidate_index, r.score) == ("1", -1, 1234.5)
    with pytest.raises(ValueError):
        files.require(rows, ["missing"])
    for i in (1, 2):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}/summary.json").write_text(json.dumps({"fps": 30.0 + i, "timings": {"all": {"p95": i}}}, indent=1))
    registry = spark.createDataFrame([("file", 1, "run1"), ("file", 2, "run2")], "source string, pair int, run_dir string")
    found = files.registered(spark, registry, str(tmp_path), "summary.json").select("pair", "fps", "timings.all.p95").collect()
    assert sorted(map(tuple, found)) == [(1, 31.0, 1), (2, 32.0, 2)]
    report = files.schema_report(spark, {"registry": registry})
    assert {(r.column, r.type, r.rows) for r in report.collect()} == {("source", "string", 2), ("pair", "int", 2), ("run_dir", "string", 2)}


def test_logs(spark):
    lines = spark.createDataFrame(
        [("RAM 2000/7600MB SWAP 10/3800MB GR3D_FREQ 55% cpu@45.5C gpu@50C",), ("RAM 1/2MB only",), ("a=b=c",), ("Throughput: 1.5 qps Throughput: 2.5 qps",)], "value string"
    )
    r = files.telemetry(lines).collect()
    assert len(r) == 1 and (r[0].ram_mb, r[0].swap_mb, r[0].load_percent, r[0].temperatures) == (2000, 10, 55, [45.5, 50.0])
    assert {tuple(x) for x in files.key_values(lines).collect()} == {("a", "b=c")}
    last = lines.select(files.last_match(F.col("value"), r"Throughput: ([\d.]+) qps").alias("q")).filter("q IS NOT NULL").first().q
    assert last == "2.5"
    path = spark.range(1).select(files.label_path(F.lit("/d/images/x/images/1.jpg"))).first()[0]
    assert path == "/d/images/x/labels/1.txt"
    assert [tuple(x) for x in files.class_names({0: "a", 2: "c"}, spark).collect()] == [(0, "a"), (1, "UNDEFINED_1"), (2, "c")]


def test_tensors(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(struct.pack("<3f", 1.0, 2.0, 3.5))
    read = files.contents(spark, str(tmp_path), "*.bin")
    assert files.tensors(read, 3).first()["values"] == [1.0, 2.0, 3.5]
    with pytest.raises(PySparkException):
        files.tensors(read, 4).collect()


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train")], "x int, y string, assigned_split string")
    files.write_csv(df, str(tmp_path / "out"), ["x"])
    assert files.csv(spark, str(tmp_path / "out")).columns == ["x"]
    with pytest.raises(PySparkException):
        files.write_csv(df, str(tmp_path / "out"), ["x"])
    files.write_union_csv([df.select("x"), df.select("y")], str(tmp_path / "union"))
    assert files.csv(spark, str(tmp_path / "union")).count() == 2
    files.write_summary(df, str(tmp_path / "json"))
    files.write_manifest(df, str(tmp_path / "manifest"))
    assert spark.read.option("header", True).csv(str(tmp_path / "manifest")).first().assigned_split == "train"
    assert json.loads(files.dataset_card(["a"], {"train": "t"}))["names"] == {"0": "a"}


def test_counter_rates(spark):
    df = spark.createDataFrame([("p", 0.0, 100.0), ("p", 1.0, 150.0), ("p", 2.0, float("nan")), ("p", 3.0, 160.0)], "source string, at double, counter double")
    rows = monitor.counter_rates(df, "source", "at", "counter").orderBy("at").collect()
    assert [rows[0].rate, rows[1].rate] == [0.0, 50.0] and [r.peak for r in rows] == [100, 150, 150, 160]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(s, float(t), float(t * t)) for s in "ab" for t in range(6)], "source string, at double, counter double")
    for part in range(3):
        df.filter(f"at >= {2 * part} AND at < {2 * part + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    run = monitor.stream_rates(source).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = monitor.counter_rates(df, "source", "at", "counter").select("source", "at", "counter", "rate", "peak").collect()
    assert sorted(out) == sorted(map(tuple, batch))


def test_batch_functions(spark, tmp_path):
    seen, stopped = [], []
    each = monitor.stop_above(90.0, "temperature", lambda b, n: seen.append((n, b.count())), lambda: stopped.append(True))
    each(spark.createDataFrame([(50.0,)], "temperature double"), 0)
    each(spark.createDataFrame([(95.0,)], "temperature double"), 1)
    assert seen == [(0, 1), (1, 1)] and stopped == [True]
    frames = spark.createDataFrame([(i, 640, 480, 2.0, 3.0) for i in range(10)], "i int, width int, height int, a double, b double")
    monitor.many_sinks({"small": lambda b: b.filter("i < 3"), "all": lambda b: b}, str(tmp_path))(frames, 0)
    monitor.many_sinks({"small": lambda b: b.filter("i < 3"), "all": lambda b: b}, str(tmp_path))(frames, 0)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 3 and spark.read.parquet(str(tmp_path / "all")).count() == 10
    assert monitor.latest_only(frames, "width", "i").first().i == 9
    assert monitor.after_warmup(frames, "i", 4).count() == 6
    assert monitor.require_geometry(frames, 640, 480).count() == 10
    with pytest.raises(PySparkException):
        monitor.require_geometry(frames, 1, 1).collect()
    r = monitor.run_summary(frames, ["a", "b"], 2.0).first()
    assert (r.frames, r.wall_rate, r.effective_rate) == (10, 5.0, 200.0)
