"""Sharding with size-tiered compaction and versioned manifests.

Arrivals are appended as runs of small immutable Parquet files. A run's tier is the
power of ``FANOUT`` of its bytes; as soon as ``FANOUT`` runs share a tier, they are
merged into one run of files of about ``TARGET_BYTES``. The live files of a version
stand in one manifest, ``_manifests/<version>.json``, which is written aside and
renamed to a name that must not exist: readers see whole versions only, and of two
writers one fails and starts over from the new version. That takes a file system whose
rename is atomic and refuses an existing name, as HDFS and local ones do; on a plain
object store let one writer commit at a time. Files that no kept version names are
deleted; the last ``KEEP_VERSIONS`` stay, for readers that began before a commit.

Merging copies bytes from many files to few without a shuffle: Spark packs the small
files into input splits of the target size, and each split becomes one file.

Defined results: empty arrivals add nothing but a version; nulls, repeated rows and
extra columns are stored as they are; schemas of arrivals must agree.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

FANOUT, TARGET_BYTES, ARRIVALS, KEEP_VERSIONS = 4, 64 << 20, 16, 2


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    name: str
    tier: int
    bytes: int
    files: tuple[str, ...]


class ShardStore:
    """Runs and manifests under ``root``, through the cluster's own file system layer."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifests"))
        # merges split their input by file sizes alone, in a session of their own
        self._merging = spark.newSession()
        for key, value in {"maxPartitionBytes": str(target_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}.items():
            self._merging.conf.set(f"spark.sql.files.{key}", value)
        # as many open files a task as there are arrivals spare the sort of whole rows
        self.dealing = spark.newSession()
        self.dealing.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(ARRIVALS))

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(self._path(f"{self.root}/_manifests")) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, T.StructType | None, list[Run]]:
        """(version, schema, runs); version 0 is empty."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return 0, None, []
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version:010d}.json"))
        try:
            data = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return version, T.StructType.fromJson(data["schema"]), [Run(r["name"], r["tier"], r["bytes"], tuple(r["files"])) for r in data["runs"]]

    def commit(self, version: int, schema: T.StructType, runs: list[Run]) -> int:
        """Publish ``runs`` as the version after ``version``, or raise Conflict."""
        aside = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": json.loads(schema.json()), "runs": [r.__dict__ | {"files": list(r.files)} for r in runs]}).encode()))
        out.close()
        final = self._path(f"{self.root}/_manifests/{version + 1:010d}.json")
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version + 1} exists")
        return version + 1

    def _listed(self, name: str) -> Run:
        files = [f for f in self._fs.listStatus(self._path(f"{self.root}/{name}")) if f.getPath().getName().endswith(".parquet") and f.getLen()]
        size = sum(f.getLen() for f in files)
        return Run(name, max(0, int(math.log(max(size, 1) / self.target * self.fanout**4, self.fanout))) if size else 0, size, tuple(sorted(f.getPath().getName() for f in files)))

    def _write(self, df: DataFrame) -> Run:
        name = f"run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self._listed(name)

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, runs = self.manifest(version)
        return self._of(schema, runs)

    def _of(self, schema: T.StructType, runs: list[Run], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        files = [f"{self.root}/{r.name}/{f}" for r in runs for f in r.files]
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    def append(self, df: DataFrame) -> int:
        """Add one arrival as a run of its own."""
        return self._add(self._write(df), df.schema)

    def _add(self, run: Run, arrived: T.StructType) -> int:
        while True:
            version, schema, runs = self.manifest()
            if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in arrived]:
                raise ValueError("an arrival's schema differs from the store's")
            try:
                return self.commit(version, arrived, [*runs, *([run] if run.files else [])])
            except Conflict:
                continue

    def append_each(self, df: DataFrame, number: Column, n: int) -> Iterator[int]:
        """Add the rows of arrival 0, 1, ... n - 1 (``number``, an int) one after the other: versions. ``df`` is read once and not shuffled; read in the session ``dealing``, it isn't sorted either."""
        name = "arrival"
        while name in {c.lower() for c in df.columns}:
            name = f"_{name}"
        folder = f"_arrivals-{uuid.uuid4().hex}"
        df.withColumn(name, number).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        for k in range(n):
            run = f"run-{uuid.uuid4().hex}"
            arrived = self._path(f"{self.root}/{folder}/{name}={k}")
            if self._fs.exists(arrived):
                self._fs.rename(arrived, self._path(f"{self.root}/{run}"))
                yield self._add(self._listed(run), df.schema)
            else:
                yield self._add(Run(run, 0, 0, ()), df.schema)
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def compact(self) -> int:
        """Merge the lowest tier that has ``fanout`` runs or more, until there is none; returns the version."""
        while True:
            version, schema, runs = self.manifest()
            full = sorted(t for t in {r.tier for r in runs} if sum(r.tier == t for r in runs) >= self.fanout)
            if not full:
                return version
            self._merge(version, schema, runs, [r for r in runs if r.tier == full[0]])

    def _merge(self, version: int, schema: T.StructType, runs: list[Run], group: list[Run]) -> None:
        merged = self._write(self._of(schema, group, self._merging))
        merged = Run(merged.name, max(merged.tier, group[0].tier + 1), merged.bytes, merged.files)
        try:
            self.commit(version, schema, [*(r for r in runs if r not in group), merged])
        except Conflict:
            self._fs.delete(self._path(f"{self.root}/{merged.name}"), True)

    def clean(self, keep: int = KEEP_VERSIONS) -> None:
        """Drop all manifests but the last ``keep``, then the runs that none of those names. For one maintenance job at a time, while no append runs."""
        versions = self.versions()
        live = {r.name for v in versions[-keep:] for r in self.manifest(v)[2]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{v:010d}.json"), False)
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("run-") and name not in live:
                self._fs.delete(f.getPath(), True)


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents arrive in ARRIVALS ranges of doc_id and are compacted after each; the last version is read back with the file of each row."""
    store = ShardStore(spark, storage.new_folder(spark, "shards"))
    docs = storage.read_table(store.dealing, sf_dir, "documents")
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", [i / ARRIVALS for i in range(1, ARRIVALS)], 10_000)).first()[0] or []))
    # rows without an identifier come first
    number = sum((F.coalesce(F.col("doc_id") > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for _ in store.append_each(docs, number, len(cuts) + 1):
        store.compact()
        store.clean()
    version, _, runs = store.manifest()
    tiers = spark.createDataFrame([(r.name, r.tier, len(r.files), r.bytes) for r in runs], "run string, tier int, run_files int, run_bytes long")
    rows = store.read().select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"), F.expr("element_at(split(_metadata.file_path, '/'), -2)").alias("run"), F.col("_metadata.file_name").alias("file"))
    return rows.join(F.broadcast(tiers), "run").withColumn("version", F.lit(version))  # a row a run: fanout runs of each tier at most
