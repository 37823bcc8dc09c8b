"""Shared parts of the corpus operators: the shared folder and cut lineage.

Conventions of every operator here
----------------------------------
* Only the columns that an operator needs are selected first, so extra columns,
  whatever their names, never clash.
* A null text counts as the empty text. A null ``doc_id`` is an ordinary value of its own.
* Repeated rows are separate rows; ties are broken by value, never by arrival.
* An empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder below the warehouse is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lathework"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM is gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: lineage ends there.

    A lost executor costs only its running tasks. Shuffle files of the writing
    query are freed as soon as the table stands.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def release(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing yet to be run reads."""
    for table in tables:
        remove(table.sparkSession, table._path)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
