"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in an order shuffled by hash, form blocks of about
``BLOCK_CHARS`` code points. With weight w (a share of all slots), block k of a source is
released at floor(k / w) and due by ceil((k + 1) / w); earliest deadline first over the
released blocks keeps each source less than one block from its share at any time. When
a source runs out, the next phase begins with the weights of those that are left: no
document is dropped or repeated.

Weights are whole tickets, exact where they fit in ``TICKETS`` parts, else rounded to
those: over a billion slots that moves a share by 1e-5 of a block. The schedule is not
simulated from its start. A slot's backlog (blocks released before it, less slots) is a
closed form, and which of the blocks under way earliest deadline first has run by a slot
follows from backlogs alone: of those blocks, taken from the latest deadline, one has
waited if no backlog since its release is used up by others that wait. So the driver keeps
one number a source, steps over ``CHUNK`` slots at a time with array arithmetic, and
Spark runs all chunks at once.

A source's order needs running sums over all of its documents; they are taken within
hash buckets and then over buckets, so no task holds a source.

Defined results: null sources are one source, ``''`` another; null or empty texts count
one code point; repeated rows stay; an empty table gives an empty result; a null
doc_id is ordered by its text. ``mix`` ignores other columns; ``mixing_stage`` keeps them,
whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

BLOCK_CHARS, BUCKETS, POWER = 100_000, 1024, 0.5
#: CHUNK * TICKETS stays below 2 ** 63.
TICKETS, CHUNK = 1 << 46, 1 << 16


def tickets(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in proportion to the weights; exact if their sum is at most TICKETS."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    divisor = math.gcd(*whole.values())
    total = sum(whole.values())
    if total // divisor <= TICKETS:
        return {s: w // divisor for s, w in whole.items()}
    return {s: max(1, round(Fraction(w * TICKETS, total))) for s, w in whole.items()}


class Progress:
    """Blocks that earliest deadline first has run by the slots that ``advance`` reaches; ties go to the source named first."""

    def __init__(self, shares: list[int]):
        self.shares, self.total = shares, sum(shares)
        self.backlog = 0
        #: Of each source's block under way: its number (-1: none), and the least backlog since its release.
        self.under_way = np.full(len(shares), -1)
        self.least = np.zeros(len(shares), np.int64)

    def advance(self, begin: int, end: int) -> list[int]:
        """Blocks of each source that have run by slot ``end``; ``begin`` is where the last call ended, CHUNK slots ago at most."""
        a, total = self.shares, self.total
        first = [-(-x * begin // total) for x in a]
        count = np.array([-(-x * end // total) - f for x, f in zip(a, first, strict=True)])
        slot, rest = (np.array(v) for v in zip(*(divmod(f * total, x) for f, x in zip(first, a, strict=True)), strict=True))
        owner = np.repeat(np.arange(len(a)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        release = slot[owner] - begin + (rest[owner] + k * total) // np.array(a)[owner]
        backlog = self.backlog + np.cumsum(np.bincount(release, minlength=end - begin)) - np.arange(1, end - begin + 1)
        since = np.minimum.accumulate(backlog[::-1])[::-1]  # least backlog after each slot, up to ``end``
        self.backlog = int(backlog[-1])

        done, open_ = [], []
        for i, x in enumerate(a):
            block, part = divmod(x * end, total)
            done.append(block)
            if part:
                freed = block * total // x
                self.least[i] = min(self.least[i], since[0]) if block == self.under_way[i] else since[freed - begin]
                open_.append((freed, -(-(block + 1) * total // x), i))
            self.under_way[i] = block if part else -1
        open_.sort()
        freed = np.array([r for r, _, _ in open_])
        room = self.least[[i for _, _, i in open_]]
        waits = set()
        for r, _, i in sorted(open_, key=lambda x: (-x[1], -x[2])):
            if len(waits) == self.backlog:
                break
            later = room[np.searchsorted(freed, r) :]
            if later.min() > 0:
                later -= 1
                waits.add(i)
        for _, _, i in open_:
            done[i] += i not in waits
        return done


def run_slots(shares: list[int], done: list[int], begin: int, end: int) -> tuple[list[int], list[int]]:
    """(source, its block) of each slot from ``begin`` to ``end``, earliest deadline first, after ``done`` blocks of each."""
    total, k = sum(shares), list(done)
    waiting = [(k[i] * total // x, i) for i, x in enumerate(shares)]
    heapq.heapify(waiting)
    due: list[tuple[int, int]] = []
    sources, blocks = [], []
    for t in range(begin, end):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(due, (-(-(k[i] + 1) * total // shares[i]), i))
        deadline, i = heapq.heappop(due)
        if t >= deadline:
            raise AssertionError("a Pfair deadline was missed")
        sources.append(i)
        blocks.append(k[i])
        k[i] += 1
        heapq.heappush(waiting, (k[i] * total // shares[i], i))
    return sources, blocks


PLAN = pa.schema([(n, pa.string() if n == "s" else pa.int64()) for n in ("chunk", "first", "begin", "end", "s", "share", "done", "base", "blocks")])


def plan(shares: Mapping[str, int], blocks: Mapping[str, int], chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of PLAN: of each chunk of slots and each source in it, what has run before.

    A phase begins at slot ``first`` with the sources that have blocks left; slots of a
    chunk, ``done`` and ``share`` count within the phase; ``base`` blocks of the source ran
    before it. It ends by the first deadline of a source's last block; the slot before
    may fall to a block that isn't there and stays empty.
    """
    left, ran, first, number = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, 0
    while left:
        names = list(left)
        own = [shares[s] for s in names]
        total = sum(own)
        end = min(-(-left[s] * total // shares[s]) for s in names)
        progress, done, begin = Progress(own), [0] * len(own), 0
        while begin < end:
            until = min(begin + chunk, end)
            for s, x, k in zip(names, own, done, strict=True):
                yield {"chunk": number, "first": first, "begin": begin, "end": until, "s": s, "share": x, "done": k, "base": ran[s], "blocks": blocks[s]}
            done, begin, number = progress.advance(begin, until), until, number + 1
        for s, k in zip(names, done, strict=True):
            k = min(k, left[s])
            ran[s] += k
            left[s] -= k
            if not left[s]:
                del left[s]
        first += end


def _run_chunk(rows: pa.Table) -> pa.Table:
    """(s, block, slot) of a chunk's slots."""
    rows = rows.to_pylist()
    first, begin, end = (rows[0][n] for n in ("first", "begin", "end"))
    sources, blocks = run_slots([r["share"] for r in rows], [r["done"] for r in rows], begin, end)
    block = np.array(blocks, np.int64) + np.array([r["base"] for r in rows])[sources]
    there = np.flatnonzero(block < np.array([r["blocks"] for r in rows])[sources])
    names = pa.array([r["s"] for r in rows])
    return pa.table({"s": names.take(pa.array(np.array(sources)[there])), "block": block[there], "slot": there + first + begin})


def schedule(spark: SparkSession, shares: Mapping[str, int], blocks: Mapping[str, int], chunk: int = CHUNK) -> DataFrame:
    """s, block, slot of every block."""
    # a row a source for each chunk of a phase: seven numbers each on the driver
    rows = pa.concat_tables([PLAN.empty_table(), *(pa.Table.from_pylist(list(part), PLAN) for part in batched(plan(shares, blocks, chunk), CHUNK))])
    if not rows.num_rows:
        return spark.createDataFrame([], "s string, block long, slot long")
    ordered = spark.createDataFrame(rows.append_column("at", pa.array(np.arange(rows.num_rows))))
    # an order of sources is a part of the schedule: ties of deadlines
    return ordered.groupBy("chunk").applyInArrow(lambda t: _run_chunk(t.sort_by("at")), "s string, block long, slot long")


def mix(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, block_chars: int = BLOCK_CHARS, chunk: int = CHUNK) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, source, block, slot, place for each row of ``docs`` (doc_id, text, source).

    Rows in order of slot, then place, are the mixture. ``weights`` by source, where
    ``None`` stands for null; by default the power ``POWER`` of the source's size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("s"),
        F.xxhash64("doc_id", text).alias("row"), F.greatest(F.length(text), F.lit(1)).cast("long").alias("size"),
    ).withColumn("bucket", F.expr(f"pmod(xxhash64(row, 77), {BUCKETS})"))
    rows = storage.materialize(spark, rows, "mix-rows")
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("chars"))
    # BUCKETS rows of a source at most
    before = sums.withColumn("before", F.coalesce(F.sum("chars").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = storage.materialize(spark, before, "mix-buckets")
    sizes = {r[0]: r[1] for r in before.groupBy("s").agg(F.sum("chars")).orderBy("s").collect()}  # a row a source
    named = None if weights is None else {"-" if k is None else f"+{k}": w for k, w in weights.items()}
    if named is not None and (lost := sizes.keys() - named.keys()):
        raise ValueError(f"no weight for {sorted(s[1:] or None for s in lost)}")
    shares = tickets({s: (named[s] if named else n**POWER) for s, n in sizes.items()}) if sizes else {}
    slots = schedule(spark, shares, {s: -(-n // block_chars) for s, n in sizes.items()}, chunk)
    inside = Window.partitionBy("s", "bucket").orderBy("row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.join(before.select("s", "bucket", "before"), ["s", "bucket"]).withColumn("start", start).withColumn("block", F.expr(f"start div {block_chars}"))
    # a long document spans several blocks and stands at the first; the slots of the others pass empty
    return placed.join(slots, ["s", "block"]).select("row", "doc_id", "source", "block", "slot", F.col("start").alias("place"))


def op10_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(storage.read_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files by range of slots, rows sorted within."""
    with storage.scratch() as kept:
        order = storage.materialize(spark, mix(docs).groupBy("row").agg(F.min("slot").alias("slot"), F.min("place").alias("place")), "mix-order")
        kept.append(order)
    end = order.agg(F.max("slot")).first()[0]
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # slots hold about equal numbers of characters, so ranges of them are files of about one size
    part = F.expr(f"int(slot * {files} div {(end or 0) + 1})")
    return docs.select(storage.whole_row(docs).alias("doc"), row.alias("row")).join(order, "row").repartitionById(files, part).sortWithinPartitions("slot", "place", "row").select("doc.*")
