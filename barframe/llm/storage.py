"""Input tables, intermediate tables in the shared folder, and shard files any executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEST_DIRS: dict[str, str] = {}
_SCRATCH: ContextVar[list] = ContextVar("scratch")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the cluster names none and Spark runs in this one process (tests), a
    temporary folder serves; on a cluster that would be wrong, so it raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _TEST_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="barframe-")
        _TEST_DIRS[app] = named
    return named if urlsplit(named).scheme else f"file://{named}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/barframe/{label}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = new_folder(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if (made := _SCRATCH.get(None)) is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete the tables that are written inside, but those that the block puts in the list."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield kept
    finally:
        _SCRATCH.reset(token)
        if (outer := _SCRATCH.get(None)) is not None:
            outer.extend(kept)
        discard(*(df for df in made if not any(df is k for k in kept)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, beside which new columns can't clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) of a URI; works in executors as on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), os.path.abspath(uri))


def put_file(uri: str, write) -> int:
    """Create the file at ``uri`` from ``write(sink)`` under a temporary name, then rename it.

    A task that is run twice (lost executor, speculation) leaves one whole file.
    Returns its size.
    """
    fsys, path = open_fs(uri)
    fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with fsys.open_output_stream(partial) as sink:
        write(sink)
        size = sink.tell()
    fsys.move(partial, path)
    return size
