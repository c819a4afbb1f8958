"""A table of bars as a stream: what a live run would have given, trigger by trigger."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints; in one local process, where none are set, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='barframe-')).rstrip('/')}/replay-{uuid.uuid4().hex}"


def replay(tables: Sequence[DataFrame], build: Callable[..., DataFrame], triggers: int = 2) -> DataFrame:
    """The rows that ``build(*streams)`` appends, with ``tables`` streamed by time in ``triggers`` parts each; all have ``time``. A table of no rows is refused."""
    spark = tables[0].sparkSession
    root, streams = _folder(spark), []
    for k, table in enumerate(tables):
        low, high = table.agg(F.min("time"), F.max("time")).first()
        # files by ranges of time, in the order of their names
        if low is None:
            raise ValueError("no bars to replay")
        for n in range(triggers):
            start, end = (low + (high + 1 - low) * x // triggers for x in (n, n + 1))
            table.where((F.col("time") >= start) & (F.col("time") < end)).coalesce(1).write.parquet(f"{root}/in{k}/{n}")
        streams.append(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in{k}"))
    out = build(*streams)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")

