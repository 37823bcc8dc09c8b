"""Row validation: every rule that a row breaks becomes an issue row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import geometry


def issues(df: DataFrame, rules: dict[str, Column], carry: list[str]) -> DataFrame:
    """One row for each broken rule, in the rules' order; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*carry, broken.alias("_broken")).select(*carry, F.explode("_broken").alias("kind"))


def repeated(keys: list[str], order: list[Column | str]) -> Column:
    """Whether a row is the second or later one of its values."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def label_lines(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Non-empty lines of whole label files: path, line number (of non-empty lines, from 1), tokens and five fields.

    Fields that are no numbers are null.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = files.select(F.col(path).alias("path"), F.posexplode(lines).alias("at", "line"))
    rows = rows.select("path", (F.col("at") + 1).alias("line_number"), F.split("line", r"\s+").alias("tokens"))
    names = ("class_id", "cx", "cy", "w", "h")
    fields = [F.expr(f"try_cast(get(tokens, {i}) AS double)").alias(n) for i, n in enumerate(names)]
    return rows.select("*", *fields)


def label_issues(lines: DataFrame, classes: int, tolerance: float = 1e-6) -> DataFrame:
    """The eight rules of label lines; a line that is malformed breaks that rule alone.

    Duplicates are flagged but stay valid.
    """
    names = ["class_id", "cx", "cy", "w", "h"]
    numbers = [F.col(n) for n in names]
    five = F.size("tokens") == 5
    numeric = five & F.forall(F.array(*[n.isNotNull() for n in numbers]), lambda x: x)
    finite = numeric & F.forall(F.array(*[geometry.finite(n) for n in numbers]), lambda x: x)
    cx, cy, w, h = (F.col(n) for n in names[1:])
    unit = lambda x: (x >= 0) & (x <= 1)
    size = (w > 0) & (h > 0) & (w <= 1) & (h <= 1)
    crosses = (
        (cx - w / 2 < -tolerance) | (cy - h / 2 < -tolerance) | (cx + w / 2 > 1 + tolerance) | (cy + h / 2 > 1 + tolerance)
    )
    rules = {
        "token_count": ~five,
        "not_numeric": five & ~numeric,
        "not_finite": numeric & ~finite,
        "duplicate_box": finite & repeated(["path", *names], ["line_number"]),
        "class_out_of_range": finite & ((F.col("class_id") != F.rint("class_id")) | ~F.col("class_id").between(0, classes - 1)),
        "center_out_of_range": finite & ~(unit(cx) & unit(cy)),
        "size_out_of_range": finite & ~size,
        "box_crosses_image_boundary": finite & crosses,
    }
    return issues(lines, rules, ["path", "line_number"])


def strict(lines: DataFrame, classes: int) -> DataFrame:
    """The lines as they are; the first bad one fails the query."""
    bad = (
        (F.size("tokens") != 5)
        | ~F.forall(F.array(*[F.coalesce(geometry.finite(F.col(n)), F.lit(False)) for n in ("class_id", "cx", "cy", "w", "h")]), lambda x: x)
        | ~F.col("class_id").between(0, classes - 1) | ~F.col("cx").between(0, 1) | ~F.col("cy").between(0, 1)
        | (F.col("w") <= 0) | (F.col("w") > 1) | (F.col("h") <= 0) | (F.col("h") > 1)
    )
    message = F.concat(F.lit("bad label line "), F.col("line_number").cast("string"), F.lit(" of "), F.col("path"))
    return lines.withColumn("class_id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message)).otherwise(F.col("class_id")))


def contiguous(df: DataFrame, keys: list[str], index: str, first: int = 0) -> DataFrame:
    """Rows whose index is not ``first`` plus their place in their group."""
    order = Window.partitionBy(*keys).orderBy(index)
    placed = df.withColumn("expected", F.row_number().over(order) - 1 + first)
    return placed.filter(F.col(index) != F.col("expected"))


def all_finite(df: DataFrame) -> Column:
    """Whether every floating column of a row is finite; nulls are not."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return F.forall(F.array(*[F.coalesce(geometry.finite(F.col(n)), F.lit(False)) for n in names]), lambda x: x)


def remap(df: DataFrame, column: str, mapping: dict, counted_as: str = "dropped") -> tuple[DataFrame, DataFrame]:
    """Rows with mapped values, and the count of rows of each value that the mapping lacks."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    marked = df.withColumn("_to", F.try_element_at(F.create_map(*pairs), F.col(column)))
    kept = marked.filter(F.col("_to").isNotNull()).withColumn(column, F.col("_to")).drop("_to")
    dropped = marked.filter(F.col("_to").isNull()).groupBy(column).agg(F.count(F.lit(1)).alias(counted_as))
    return kept, dropped
