"""Readers and writers of the file formats that the audits and benchmarks use."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png", "bmp")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGES, hidden: bool = False) -> DataFrame:
    """path, length and modificationTime of files with the extensions, any case, below the folder.

    Paths with a part that begins with a dot are left out unless ``hidden``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    rows = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return rows if hidden else rows.filter(~F.col("path").rlike(r"/\.[^/]"))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, sha256 and content of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content")


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A header CSV; strings without a schema; a byte-order mark is dropped."""
    reader = spark.read.option("header", "true").option("encoding", "UTF-8").option("mode", "FAILFAST")
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first = rows.columns[0] if rows.columns else ""
    return rows.withColumnRenamed(first, first.lstrip(chr(0xFEFF))) if first.startswith(chr(0xFEFF)) else rows


def require(df: DataFrame, columns: list[str], aliases: dict[str, str] | None = None, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns, by their aliases or defaults; raises if one is missing."""
    for name, other in (aliases or {}).items():
        if name not in df.columns and other in df.columns:
            df = df.withColumnRenamed(other, name)
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON documents, one a file, with their path."""
    rows = spark.read.option("multiLine", "true").json(paths)
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def registered(spark: SparkSession, registry: DataFrame, folder: str, name: str) -> DataFrame:
    """The registry's rows joined to the document ``name`` in each row's ``run_dir``."""
    paths = [f"{r.run_dir.rstrip('/')}/{name}" for r in registry.select("run_dir").distinct().collect()]  # a registry is short
    rows = documents(spark, [p if "://" in p or p.startswith("/") else f"{folder}/{p}" for p in paths])
    end = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return registry.withColumn("_run", F.regexp_extract("run_dir", r"([^/]+)/?$", 1)).join(rows.withColumn("_run", end), "_run").drop("_run")


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """key and value of ``key=value`` lines, split at the first sign."""
    parts = F.split(F.col(column), "=", 2)
    return lines.filter(F.col(column).contains("=")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def newest(listing_: DataFrame, marker: str) -> DataFrame:
    """The folder with the most recent file named ``marker``."""
    marked = listing_.filter(F.col("path").endswith(f"/{marker}"))
    return marked.agg(F.max_by(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.struct("modificationTime", "path")).alias("folder"))


def telemetry(lines: DataFrame, column: str = "value") -> DataFrame:
    """Memory, swap, load and temperatures of log lines that carry all three of the first."""
    text = F.col(column)
    number = lambda pattern: F.regexp_extract(text, pattern, 1)
    rows = lines.select(
        text.alias("line"),
        number(r"RAM (\d+)/\d+MB").alias("ram_mb"),
        number(r"SWAP (\d+)/\d+MB").alias("swap_mb"),
        number(r"GR3D_FREQ (\d+)%").alias("load_percent"),
        F.transform(F.regexp_extract_all(text, F.lit(r"@(-?\d+(?:\.\d+)?)C"), F.lit(1)), lambda s: s.cast("double")).alias("temperatures"),
    )
    rows = rows.filter("ram_mb <> '' AND swap_mb <> '' AND load_percent <> ''")
    return rows.select("line", *[F.col(c).cast("double").alias(c) for c in ("ram_mb", "swap_mb", "load_percent")], "temperatures")


def last_match(text: Column, pattern: str) -> Column:
    """The first group of the pattern's last match, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def plain_number(text: Column) -> Column:
    """A number that may carry thousands commas, or null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def label_path(path: Column) -> Column:
    """The label file of an image: its last ``images`` folder becomes ``labels``, its extension txt."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]+$", ".txt")


def tensors(files: DataFrame, count: int | None = None) -> DataFrame:
    """path and values of raw little-endian float32 files; an unexpected length raises."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def values(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, "<f4"))

    rows = files.select("path", values("content").alias("values"))
    if count is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit("unexpected length of "), F.col("path")))
    return rows.withColumn("values", F.when(F.size("values") == count, F.col("values")).otherwise(wrong))


def class_names(names: list[str] | dict[int, str], spark: SparkSession) -> DataFrame:
    """class_id and class_name from a list or a map; gaps are named UNDEFINED_i."""
    found = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}
    rows = [(i, found.get(i, f"UNDEFINED_{i}")) for i in range(max(found, default=-1) + 1)]
    return spark.createDataFrame(rows, "class_id int, class_name string")


def schema_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type and the table's row count."""
    parts = None
    for name, df in sorted(tables.items()):
        columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema])
        own = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.explode(columns).alias("c"), "rows")
        own = own.select("table", "c.*", "rows")
        parts = own if parts is None else parts.union(own)
    return parts


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """The named columns only; an existing output raises unless ``overwrite``."""
    df.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").csv(path)


def write_union_csv(parts: list[DataFrame], path: str) -> None:
    """Rows of unlike columns: the union of the columns, nulls where a part lacks one."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("errorifexists").option("header", "true").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON documents."""
    df.write.mode("errorifexists").json(path)


def write_manifest(df: DataFrame, path: str, split: str = "assigned_split") -> None:
    """A split manifest in a folder for each split."""
    df.write.mode("errorifexists").partitionBy(split).option("header", "true").csv(path)


def dataset_card(names: list[str], splits: dict[str, str]) -> str:
    """The dataset description that goes with a split manifest."""
    return json.dumps({"splits": splits, "names": dict(enumerate(names))}, indent=2)
