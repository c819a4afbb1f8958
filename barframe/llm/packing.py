"""Best-fit packing under conflicts.

Documents become pieces of at most ``capacity`` code points, which go into bins of
that capacity. Pieces are taken from the longest; each goes to the bin with the least
residual that holds it and has no conflict. Bins stand in a list ordered by residual;
each carries a bitmap of its duplicate clusters and two of its sources (present once,
present twice): a bin holds a cluster once and a source ``max_same_source`` (1 or 2)
times. The search starts at the successor of the piece's length and goes on until a
compatible bin is found; only then a new bin opens.

Groups of about ``GROUP_PIECES`` pieces are packed independently, so a task's memory is
bounded and nothing is left over but a few bins of each group. Groups are dealt by a hash,
or, in the pipeline, are consecutive documents of the mixture as it was written, and bins
come in that order.

Defined results: null or empty text has no piece and is in no bin; null sources are one source; repeated rows are copies, so never in one bin;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

CAPACITY, GROUP_PIECES, MAX_SAME_SOURCE = 8192, 2048, 2


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, max_same_source: int = MAX_SAME_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece (length, source, cluster), taken in the order given."""
    clusters, once, twice, residual = [], [], [], []
    open_: list[tuple[int, int]] = []  # (residual, bin), ordered
    counts = {"s": 0, "c": 0}
    number: dict[tuple[str, int], int] = {}

    def bitmap(kind: str, x: int) -> int:
        if (kind, x) not in number:
            number[kind, x] = counts[kind]
            counts[kind] += 1
        return 1 << number[kind, x]

    out = []
    for length, source, cluster in pieces:
        s, c = bitmap("s", source), bitmap("c", cluster)
        at = bisect_left(open_, (length, -1))
        while at < len(open_):
            b = open_[at][1]
            if not clusters[b] & c and not (twice if max_same_source > 1 else once)[b] & s:
                break
            at += 1
        if at < len(open_):
            open_.pop(at)
        else:
            b = len(residual)
            residual.append(capacity)
            clusters.append(0)
            once.append(0)
            twice.append(0)
        out.append((b, capacity - residual[b]))
        residual[b] -= length
        twice[b] |= once[b] & s
        once[b] |= s
        clusters[b] |= c
        if residual[b]:
            insort(open_, (residual[b], b))
    return out


PACKED = "grp long, bin int, bin_offset int, piece int, size int, doc_id long, row long, source string, pos long"


def pack(items: DataFrame, capacity: int = CAPACITY, max_same_source: int = MAX_SAME_SOURCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, row, piece, size, source, bin, bin_offset, grp, pos for each piece of ``items`` (doc_id, row, size, source, cluster).

    A piece of the full capacity is a bin of its own. Where ``items`` have ``pos``, their
    place in an order, a group is ``group_pieces`` consecutive places (a document has one
    piece below the capacity at most); else groups are dealt by a hash and ``pos`` is 0.
    """
    spark = items.sparkSession
    ranged = "pos" in items.columns
    items = items if ranged else items.withColumn("pos", F.lit(0).cast("long"))
    rows = items.where("size > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, int((size - 1) div {capacity}))")))
    rows = rows.withColumn("size", F.expr(f"int(least(size - bigint(piece) * {capacity}, {capacity}))"))
    # copies of a repeated row are numbered: each is a bin
    copy = F.row_number().over(Window.partitionBy("row", "piece").orderBy("pos", "doc_id", "source"))
    whole = rows.where(F.col("size") == capacity).withColumn("copy", copy).select("doc_id", "row", "piece", "size", "source", F.expr("concat('f', hex(row), '-', piece, '-', copy)").alias("bin"), F.lit(0).alias("bin_offset"), F.expr(f"pos div {group_pieces}").alias("grp"), "pos")
    loose = storage.materialize(spark, rows.where(F.col("size") < capacity), "pieces")
    deal = f"pos div {group_pieces}" if ranged else f"pmod(xxhash64(row, piece), {max(1, -(-loose.count() // group_pieces))})"
    dealt = loose.withColumn("grp", F.expr(deal)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp")
    ordered = dealt.select("grp", "size", "piece", "doc_id", "row", "source", "cluster", "pos").sortWithinPartitions("grp", F.desc("size"), "row", "piece", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PACKED.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for grp, group in groupby(stream, key=lambda r: r[0]):
            group = list(group)  # about group_pieces
            got = best_fit([(r[1], r[5], r[6]) for r in group], capacity, max_same_source)
            _, size, piece, doc_id, row, source, _, pos = zip(*group, strict=True)
            cols = [[grp] * len(group), [b for b, _ in got], [o for _, o in got], piece, size, doc_id, row, source, pos]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    packed = ordered.mapInArrow(run, PACKED).select("doc_id", "row", "piece", "size", "source", F.expr("concat('g', grp, '-', bin)").alias("bin"), "bin_offset", "grp", "pos")
    return packed.union(whole)


def items_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), size, source, cluster and ``more`` of each row of ``docs``; texts equal but for case and white space are a cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("row"), F.length(text).cast("long").alias("size"), F.col("source").cast("string"), F.xxhash64(plain).alias("cluster"), *more)


def in_order(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, source and pos, the place of each row as its files hold them; number of rows). Rows that come from no file are written first."""
    docs = docs.select("doc_id", "text", "source")
    file = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")]
    try:
        rows = docs.select("*", *file)
    except AnalysisException:
        rows = storage.materialize(spark, docs, "ordered").select("*", *file)
    sizes = rows.groupBy("file").agg(F.max("index").alias("last")).collect()  # a row a file
    at, first = 0, []
    for name, last in sorted(sizes, key=lambda r: (int((re.findall(r"part-(\d+)", r[0]) or [0])[-1]), r[0])):
        first.append((name, at))
        at += last + 1
    starts = F.broadcast(spark.createDataFrame(first, "file string, first long"))
    return rows.join(starts, "file").select("doc_id", "text", "source", (F.col("first") + F.col("index")).alias("pos")), at


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies; documents without text have none."""
    items = items_of(storage.read_table(spark, sf_dir, "documents"))
    return pack(items).select("doc_id", "source", "piece", "size", "bin", "bin_offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """bin, n_pieces, used, doc_ids, text, place: the training sequences, each of at most CAPACITY code points.

    Groups are consecutive documents of ``docs`` in the order of its files; a bin's ``place`` is that of
    its first document, and bins come in that order.
    """
    placed, total = in_order(spark, docs)
    with storage.scratch() as kept:
        packed = storage.materialize(spark, pack(items_of(placed, F.col("pos")), group_pieces=GROUP_PIECES), "packed")
        kept.append(packed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("doc_id", text).alias("_row"), text.alias("text"))
    if not packed.groupBy("doc_id", "row", "piece").count().where("count > 1").isEmpty():
        texts = texts.groupBy("_id", "_row").agg(F.first("text").alias("text"))  # repeated rows: one text for all their places
    part = F.expr(f"substring(text, piece * {CAPACITY} + 1, size)")
    parts = packed.join(texts, F.expr("doc_id <=> _id AND row = _row")).select("grp", "bin", F.struct("bin_offset", "doc_id", part.alias("part")).alias("p"), "size", F.struct("pos", "piece").alias("at"))
    # dealt by range of groups: bins are whole in a task, and tasks are in order
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("task", F.expr(f"int(grp * {tasks} div {total // GROUP_PIECES + 1})")).repartitionById(tasks, "task")
    bins = parts.groupBy("task", "grp", "bin").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("size").alias("used"), F.count("*").alias("n_pieces"), F.min("at").alias("at"))  # CAPACITY code points at most
    return bins.sortWithinPartitions("grp", "at", "bin").select("bin", "n_pieces", "used", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.part", "").alias("text"), F.col("at.pos").alias("place"))
