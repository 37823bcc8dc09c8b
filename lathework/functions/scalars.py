"""Names, numbers, units, times and nested documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Bytes of a unit, and milliseconds of a unit.
BYTES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
MILLISECONDS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3, "min": 6e4}


def normal_name(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def without_copy_number(name: Column) -> Column:
    """Drops a ``(1)`` at the end."""
    return F.regexp_replace(name, r"\s*\(\d+\)$", "")


def flat_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def number_with_commas(text: Column) -> Column:
    """A number whose thousands may be parted by commas; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _scaled(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    pairs = [x for name, factor in factors.items() for x in (F.lit(name), F.lit(float(factor)))]
    return value * F.try_element_at(F.create_map(*pairs), unit)


def in_bytes(value: Column, unit: Column) -> Column:
    """Null for an unknown unit."""
    return _scaled(value, unit, BYTES)


def in_milliseconds(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, MILLISECONDS)


def elapsed(df: DataFrame, time: str, name: str = "elapsed") -> DataFrame:
    """Seconds since the first time of all rows; the first is one aggregated row."""
    first = df.agg(F.min(F.unix_micros(time)).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(name, (F.unix_micros(time) - F.col("_first")) / 1e6).drop("_first")


def _leaves(kind: DataType, at: Column, path: Column) -> Column:
    """An array of (path, value) of a nested column."""
    if isinstance(kind, StructType):
        parts = [_leaves(f.dataType, at[f.name], F.concat(path, F.when(path == "", "").otherwise("."), F.lit(f.name))) for f in kind.fields]
        return F.concat(*parts)
    if isinstance(kind, ArrayType):
        each = F.transform(at, lambda x, i: _leaves(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), at.cast("string").alias("value")))


def flattened(df: DataFrame, key: str, doc: str) -> DataFrame:
    """``key, path, value``: a row for each leaf of a nested column."""
    leaf = _leaves(df.schema[doc].dataType, F.col(doc), F.lit(""))
    return df.select(key, F.explode(leaf).alias("leaf")).select(key, "leaf.path", "leaf.value")
