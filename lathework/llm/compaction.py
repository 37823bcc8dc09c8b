"""Size-tiered compaction of immutable shards under a versioned manifest (operator 3).

Arrivals are appended as small parquet shards that never change. Shards of one size
tier (sizes within a factor of ``fanout``) are merged, run by run, into files of about
``target_bytes``; a run is merged when it has at least ``fanout`` shards or fills a
target file. Each change of the set of shards is a new manifest version: it is written beside its
final name and renamed to it, which fails if that version exists, so of two
writers one wins and readers see either version whole. A writer that loses commits its files again
on top of the winner's version, unless that merged the same shards. ``vacuum`` removes files that an expired version names and none of
the last ``keep_versions`` does, once the version that dropped them is ``grace_ms`` old, and those
manifests after them; files that no manifest names belong to a writer under way and stay.

The data path is DataFrame reads and writes only. The driver handles the manifest: one
line for each shard, so a few hundred thousand lines at 100 TB. Each merge has a partition of
its own, and shards of a run hold at most ``target_bytes`` together, which bounds a task; no key
of the data decides where a row goes, so no source or copy can make one task large.

Defined cases: nulls in any column, long texts, ties and repeated rows pass through
unchanged; an empty arrival makes no shard; extra columns are kept as they are.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lathework.llm import common


def _name(path: str) -> str:
    """A file's folder and name; runs written by one task share the name alone."""
    return "/".join(path.rsplit("/", 2)[1:])


def _name_column() -> F.Column:
    return F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1)


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(
        self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fanout: int = 4, keep_versions: int = 2, grace_ms: int = 0
    ):
        self.spark, self.path, self.grace_ms = spark, path.rstrip("/"), grace_ms
        self.target_bytes, self.fanout, self.keep_versions = target_bytes, fanout, keep_versions
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int, bool]]:
        if not self._fs.exists(self._p(path)):
            return []
        return [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(self._p(path))]

    # -- manifest ---------------------------------------------------------

    def versions(self) -> list[int]:
        names = (p.rsplit("/", 1)[1] for p, _, _ in self._list(f"{self.path}/manifest"))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict:
        """The given or latest version: ``version``, ``schema`` and ``shards`` (file, bytes, level, run)."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._p(self._manifest_path(version or found[-1])))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, before: dict, shards: list[dict], schema: str) -> dict:
        after = {"version": before["version"] + 1, "schema": schema, "shards": shards}
        folder = f"{self.path}/manifest"
        self._fs.mkdirs(self._p(folder))
        draft, final = self._p(f"{folder}/draft-{uuid.uuid4().hex}"), self._p(self._manifest_path(after["version"]))
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {after['version']} exists")
        return after

    # -- data -------------------------------------------------------------

    def _written(self, folder: str, level: int) -> list[dict]:
        """The shards in ``folder``; each folder or file holds one run."""
        found = []
        for path, size, is_dir in sorted(self._list(folder)):
            files = self._list(path) if is_dir else [(path, size, False)]
            for file, n, _ in sorted(files):
                if file.endswith(".parquet"):
                    found.append({"file": file, "bytes": n, "level": level})
        return found

    def append(self, arrival: DataFrame, rows_per_shard: int = 2000) -> dict:
        """Writes the arrival's partitions as small shards and commits them, on top of whatever others commit meanwhile."""
        folder = f"{self.path}/data/a{uuid.uuid4().hex}"
        nested = arrival.select(F.struct("*").alias("row"))  # one column, so no name of the data can clash
        nested.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        filled = self._written(folder, 0)
        counts = self._rows(folder, filled, nested)
        new = [s | {"rows": counts[_name(s["file"])]} for s in filled if _name(s["file"]) in counts]
        while True:
            before = self.manifest()
            try:
                return self.commit(before, before["shards"] + new, before["schema"] or arrival.schema.json())
            except Conflict:  # another version came first; shards only add up
                continue

    def _rows(self, folder: str, shards: list[dict], like: DataFrame) -> dict[str, int]:
        if not shards:
            return {}
        read = self.spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(folder)
        return {r[0]: r[1] for r in read.groupBy(_name_column()).count().collect()}  # one row a shard

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        stored = StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType()
        return StructType().add("row", stored)

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fanout))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: shards of one tier, oldest first, up to the target size."""
        by_tier: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target_bytes // 2:
                by_tier.setdefault(self.tier(s["bytes"]), []).append(s)
        merges = []
        for _, own in sorted(by_tier.items()):
            run, size = [], 0
            for s in own:
                if run and size + s["bytes"] > self.target_bytes:
                    merges.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            merges.append(run)
        return [r for r in merges if len(r) >= self.fanout or (len(r) > 1 and sum(s["bytes"] for s in r) >= self.target_bytes // 2)]

    def compact(self) -> bool:
        """One round of merges; whether there was anything to merge."""
        before = self.manifest()
        merges = self.plan(before["shards"])
        if not merges:
            return False
        number = {_name(s["file"]): i for i, run in enumerate(merges) for s in run}
        # one row a shard of this round
        of = self.spark.createDataFrame(sorted(number.items()), "shard_name string, merge_run int")
        rows = self.spark.read.schema(self._schema(before)).parquet(*[s["file"] for run in merges for s in run])
        packed = rows.select("row", _name_column().alias("shard_name"))
        folder = f"{self.path}/data/m{uuid.uuid4().hex}"
        (
            packed.join(F.broadcast(of), "shard_name")
            .select("merge_run", "row")
            .repartitionById(len(merges), F.col("merge_run"))  # a partition a run
            .write.option("compression", "zstd")
            .partitionBy("merge_run")
            .parquet(folder)
        )
        merged = self._merged(folder, merges)
        gone = {s["file"] for run in merges for s in run}
        while True:
            latest = self.manifest()
            if not gone <= {s["file"] for s in latest["shards"]}:  # another writer merged some of them
                self._fs.delete(self._p(folder), True)
                raise Conflict(f"shards of version {before['version']} were merged by another writer")
            try:
                self.commit(latest, [s for s in latest["shards"] if s["file"] not in gone] + merged, before["schema"])
            except Conflict:
                continue
            self.vacuum()
            return True

    def _merged(self, folder: str, merges: list[list[dict]]) -> list[dict]:
        found = []
        for s in self._written(folder, 1):
            run = int(s["file"].split("merge_run=")[1].split("/")[0])
            found.append(s | {"level": 1 + max(x["level"] for x in merges[run]), "rows": sum(x["rows"] for x in merges[run])})
        return found

    def vacuum(self) -> None:
        """Removes the files of expired versions that no kept version names, then the expired manifests."""
        found = self.versions()
        expired, kept = found[: -self.keep_versions], found[-self.keep_versions :]
        newest = {v: self._fs.getFileStatus(self._p(self._manifest_path(v))).getModificationTime() for v in found}
        now = int(time.time() * 1000)
        named = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        for v, after in zip(expired, found[1:]):
            if newest[after] + self.grace_ms > now:  # a reader of it may still be under way
                break
            for s in self.manifest(v)["shards"]:
                if s["file"] not in named:
                    self._fs.delete(self._p(s["file"]), False)
            self._fs.delete(self._p(self._manifest_path(v)), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard`` (its number in the manifest), ``level`` and ``version``."""
        found = self.manifest(version)
        names = [(_name(s["file"]), i, s["level"]) for i, s in enumerate(found["shards"])]
        of = self.spark.createDataFrame(names, "shard_name string, shard int, level int")
        files = [s["file"] for s in found["shards"]]
        reader = self.spark.read.schema(self._schema(found))
        rows = (
            reader.parquet(*files).select("row", _name_column().alias("shard_name"))
            if files
            else self.spark.createDataFrame([], self._schema(found).add("shard_name", "string"))
        )
        return rows.join(F.broadcast(of), "shard_name").select(  # one row a shard
            "row", "shard", "level", F.lit(found["version"]).alias("version")
        )


def compacted(docs: DataFrame, arrivals: int = 2, rows_per_shard: int = 2000, target_bytes: int = 64 << 20) -> ShardStore:
    """A store into which ``docs`` came as ``arrivals`` arrivals, compacted after each."""
    spark = docs.sparkSession
    store = ShardStore(spark, common.new_path(spark, "shards"), target_bytes)
    for i in range(arrivals):
        store.append(docs.filter(F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(arrivals)) == i), rows_per_shard)
        while store.compact():
            pass
    return store


def op3_compaction(spark, sf_dir):
    """Every document with the shard that holds it after the last commit."""
    rows = compacted(spark.read.parquet(f"{sf_dir}/documents.parquet")).read()
    return rows.select(
        "row.doc_id",
        F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"),
        "shard",
        "level",
        "version",
    )
