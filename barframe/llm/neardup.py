"""Near duplicates by min-max hashing, confirmed on full shingle sets.

A permutation gives two signature slots, its least and its greatest value, so
``PERMUTATIONS`` hash evaluations give twice as many slots. Bands of ``ROWS``
slots find candidates: at the limit of 0.75 a pair shares no band with
probability (1 - 0.75**4)**32 = 5e-6. Every link counts only after its exact
Jaccard index on full sets of 64-bit shingle hashes.

The work:

1. documents with equal sets form classes; their least doc_id stands for them;
2. in each band bucket the members are compared, by signature, with the least of them
   (a star); the components of pairs that agree in ``MIN_AGREE`` slots are *clusters*;
3. members of a bucket that are outside its largest cluster are compared by signature
   with all others, in groups of two blocks, of which each emits a spanning forest at most;
4. each text goes to its cluster's block of ``BLOCK`` rows once, where pairs not yet
   connected are confirmed on full sets, likeliest first; a cluster of several blocks
   sends some leaders to all of them;
5. where such a cluster is still in several components, the rows outside the largest
   are confirmed against all rows, in groups of two blocks. If they are more than a block, an
   exact bound comes first: a link needs 6/7 of the smaller set, and 3/4 of the larger, to be
   found in other components at all. Texts grown from one template, however many, end there;
6. components of the confirmed links, by label propagation.

A group holds about two blocks, whatever the cluster. Keys with very many rows are dealt in parts.

Defined results: null or wordless text has an empty set and links with nothing;
rows with a null doc_id keep component_id null and are kept; rows that share a
doc_id are one document, whose links are those of all its texts; equal rows give equal
result rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .bitmap import hash_bits, in_bits, may_be_in
from .graph import components
from .skew import spread_join
from .storage import discard, materialize, read_table, scratch

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
SLOTS = 2 * PERMUTATIONS
BANDS = SLOTS // ROWS
#: Of 128 slots 96 agree at a Jaccard index of 0.75, with a deviation of 4.9; 74 is 4.5 deviations below.
MIN_AGREE = 74
BLOCK = 256
WIDE_LEADERS = 3
LIMIT = 75

_U = np.uint64
_MUL = tk._mixed(PERMUTATIONS, 101) | _U(1)
_ADD = tk._mixed(PERMUTATIONS, 202)
_BAND = tk._mixed(SLOTS, 303) | _U(1)
_FOLD = _U(0x9E3779B97F4A7C15)
SKETCH = "row long, doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, SLOTS) of 32 bits: slots 2p and 2p + 1 are permutation p's least and greatest value, folded."""
    out = np.zeros((len(sets), SLOTS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 1 << 16):
            size += len(sets[full[end]])
            end += 1
        rows = full[at:end]
        x = np.concatenate([sets[r] for r in rows]) if len(rows) > 1 else sets[rows[0]]
        cuts = np.cumsum([0, *(len(sets[r]) for r in rows[:-1])])
        for p in range(PERMUTATIONS):
            v = x * _MUL[p]
            v += _ADD[p]
            out[rows, 2 * p] = ((np.minimum.reduceat(v, cuts) * _FOLD) >> _U(32)).astype(np.uint32)
            out[rows, 2 * p + 1] = ((np.maximum.reduceat(v, cuts) * _FOLD) >> _U(32)).astype(np.uint32)
        at = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys; a band takes its slots from different quarters, so never two of one permutation."""
    order = np.arange(SLOTS).reshape(ROWS, BANDS).T.ravel()
    weighed = signature[:, order].astype(_U) * _BAND
    return tk.mix(weighed.reshape(len(signature), BANDS, ROWS).sum(2, dtype=_U) + np.arange(1, BANDS + 1, dtype=_U) * _FOLD).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, off = tk.utf8(batch.column(1))
        for i, j in tk.slices(off):
            sets = tk.shingle_sets(data, off[i : j + 1], SHINGLE)
            sig = signatures(sets)
            keys = band_keys(sig)
            n = np.array([len(s) for s in sets], np.int64)
            f1 = np.array([s.sum(dtype=_U) for s in sets], _U).view(np.int64)
            f2 = np.array([np.bitwise_xor.reduce(tk.mix(s)) if len(s) else 0 for s in sets], _U).view(np.int64)
            full = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), pa.array(n), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel()))],
                names=[x.split()[0] for x in SKETCH.split(", ")],
            )
            row += j - i


def sketch(docs: DataFrame) -> DataFrame:
    """A number, set size, 128-bit set fingerprint, min-max signature and band keys of each row of ``docs``. Numbers hold once the result is written."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch, SKETCH)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, signature of a, of b), the pairs that agree in MIN_AGREE slots."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SLOTS) for c in (2, 3))
        good = np.flatnonzero((x == y).sum(1) >= MIN_AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good))], names=["a", "b"])


class _Forest:
    """Union-find over few rows, as an array of roots."""

    def __init__(self, groups):
        self.root = np.unique(np.asarray(groups), return_inverse=True)[1]

    def join(self, x: int, y: int) -> None:
        self.root[self.root == self.root[y]] = self.root[x]


def _candidates(forest: _Forest, slots: np.ndarray, n: np.ndarray, x: int) -> np.ndarray:
    """Rows before x, not connected with it, that agree with it in MIN_AGREE slots; most slots first."""
    near = (forest.root[:x] != forest.root[x]) & (100 * np.minimum(n[:x], n[x]) >= LIMIT * np.maximum(n[:x], n[x]))
    at = np.flatnonzero(near)
    agree = (slots[at] == slots[x]).sum(1)
    good = agree >= MIN_AGREE
    return at[good][np.argsort(-agree[good], kind="stable")]


def _pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


SENT = ("g", "i", "j", "new", "rep", "comp", "n", "f1", "signature", "text")


def _compared(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SENT, sorted: a forest of links between components, in each group (g, i, j) of the ``new`` rows with all others.

    Links are pairs that agree in MIN_AGREE slots; with ``exact``, those confirmed on full sets.
    """
    a, b = [], []
    for _, rows in groupby(_rows(batches), key=lambda r: r[:3]):
        rows = list(rows)  # about two blocks
        sets = tk.shingle_sets(*tk.utf8(pa.array([r[9] for r in rows], pa.large_string())), SHINGLE) if exact else []
        own: dict[tuple, int] = {}
        for k, r in enumerate(rows):
            # where a doc_id has several texts, signatures stay with their own
            if not exact or sets[k].sum(dtype=_U) == _U(r[7] % (1 << 64)):
                own.pop((r[4], r[7]), None)  # a row that comes on both sides counts as new
                own[r[4], r[7]] = k
        if len(own) < 2:
            continue
        rows, sets = [rows[k] for k in own.values()], [sets[k] for k in own.values()] if exact else []
        forest, n = _Forest([r[5] for r in rows]), np.array([r[6] for r in rows])
        slots = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(-1, SLOTS)
        for x in range(max(sum(not r[3] for r in rows), 1), len(rows)):
            for y in _candidates(forest, slots, n, x):
                if forest.root[x] == forest.root[y]:
                    continue
                if exact:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both < LIMIT * (len(sets[x]) + len(sets[y]) - both):
                        continue
                forest.join(x, y)
                a.append(rows[y][4])
                b.append(rows[x][4])
        if len(a) > 4096:
            yield _pairs_batch(a, b)
            a, b = [], []
    yield _pairs_batch(a, b)


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Of rows (g, f1, text, ...): slices of them, with the set of each, hashed with g; empty where ``f1`` is that of another text."""
    for batch in batches:
        data, off = tk.utf8(batch.column(2))
        for i, j in tk.slices(off):
            part = batch.slice(i, j - i)
            salt = np.asarray(part.column(0)).astype(np.int64).view(_U) * _FOLD
            sets = tk.shingle_sets(data, off[i : j + 1], SHINGLE)
            yield part, [tk.mix(s ^ c) if s.sum(dtype=_U) == _U(f % (1 << 64)) else s[:0] for s, c, f in zip(sets, salt, part.column(1).to_pylist(), strict=True)]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, f1, text, comp): (comp, token) for each shingle."""
    for part, sets in _token_sets(batches):
        at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        yield pa.RecordBatch.from_arrays([part.column(3).take(at), pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))], names=["comp", "token"])


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("size"))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of distinct ``pairs``, those whose signatures agree enough; ``a`` may be in very many."""
    x = reps.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    y = reps.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    led = spread_join(pairs, x, "a", "b", _sizes(pairs, "a"), pairs.count())
    return led.join(y, "b").select("a", "b", "x", "y").mapInArrow(_agreeing, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Groups of two blocks for ``rows`` (g, rep, odd, size, n_odd, ...): each odd row meets each row of its g once."""
    rows = rows.withColumn("wide", F.expr(f"int(ceil(size / {BLOCK}))")).withColumn("many", F.expr(f"int(ceil(n_odd / {BLOCK}))"))
    i, j = F.expr("int(pmod(xxhash64(rep, 1), many))"), F.expr("int(pmod(xxhash64(rep), wide))")
    new = rows.where("odd").withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(0, wide - 1)"))).withColumn("new", F.lit(True))
    old = rows.withColumn("j", j).withColumn("i", F.explode(F.expr("sequence(0, many - 1)"))).withColumn("new", F.lit(False))
    return new.unionByName(old).drop("wide", "many", "odd", "size", "n_odd")


def _forest(rows: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) found in the groups of ``rows`` of SENT."""
    groups = rows.select(*SENT).repartition(_tasks(rows.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j", "new", "rep")
    return materialize(rows.sparkSession, groups.mapInArrow(lambda batches: _compared(batches, exact), "a long, b long").distinct(), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label) after ``links`` (a, b) join some of ``labels``'s; only the labels at the links' ends are searched again."""
    end = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    roots = components(ends).select(F.col("node").alias("label"), F.col("label").alias("root"))
    old = labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("root").alias("label"))
    return materialize(links.sparkSession, old.union(new), "merged")


def _clusters(spark: SparkSession, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, label): the clusters that may hold links; the (rep, n, f1, signature) that they are made of)."""
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    busy = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("lead")).where("size > 1")
    busy = materialize(spark, busy, "busy")
    total = BANDS * reps.count()
    buckets = materialize(spark, spread_join(rows, busy, "key", "rep", busy, total), "buckets")
    # signatures travel only for those that share a bucket
    reps = materialize(spark, reps.select("rep", "n", "f1", "signature").join(buckets.select("rep").distinct(), "rep", "left_semi"), "signatures")
    near = F.expr(f"100 * least(n, lead.n) >= {LIMIT} * greatest(n, lead.n)")
    star = materialize(spark, buckets.where(near & F.expr("rep <> lead.rep")).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    clusters = components(likely(star, reps))
    labelled = buckets.join(clusters.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    labelled = materialize(spark, labelled, "labelled")
    discard(buckets, star)
    # of three rows or more: a star settles two
    per = labelled.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("size"), F.max(F.struct("count", "comp")).alias("main"), F.count("*").alias("comps"))
    split = materialize(spark, per.where("size > 2 AND comps > 1").select("key", "size", F.expr("size - main.count").alias("n_odd"), F.col("main.comp").alias("main")), "split")
    rest = spread_join(labelled, split, "key", "rep", busy, total).join(reps, "rep")
    rest = rest.select(F.col("key").alias("g"), "rep", "comp", "n", "f1", "signature", F.lit(None).cast("string").alias("text"), (F.col("comp") != F.col("main")).alias("odd"), "size", "n_odd")
    more = _forest(_dealt(rest), False)
    discard(labelled, split, busy)
    return (clusters if more.isEmpty() else _merged(clusters, more)), reps


def _components(spark: SparkSession, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of every representative that has a link."""
    clusters, signed = _clusters(spark, reps)
    placed = clusters.withColumnRenamed("node", "rep").withColumnRenamed("label", "cluster")
    luck = [F.min(F.struct(F.xxhash64("rep", F.lit(t)), "rep"))["rep"] for t in range(WIDE_LEADERS)]
    wide = placed.groupBy("cluster").agg(F.count("*").alias("size"), F.array_distinct(F.array(*luck)).alias("leads")).where(f"size > {BLOCK}")
    wide = materialize(spark, wide.withColumn("blocks", F.expr(f"int(ceil(size / {BLOCK}))")), "wide")
    total = placed.count()
    placed = spread_join(placed, wide.select("cluster", "blocks"), "cluster", "rep", wide, total, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = materialize(spark, placed.withColumn("i", F.expr("int(pmod(xxhash64(rep), blocks))")), "placed")
    wanted = may_be_in(texts, "rep", placed.select("rep")).where("hit").select("row.*")
    members = materialize(spark, placed.select("rep").join(signed, "rep").join(wanted, "rep"), "members")
    discard(signed)
    leads = wide.select("cluster", F.explode("leads").alias("rep"), "blocks").select("cluster", "rep", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"))
    rows = placed.select("cluster", "rep", "i").union(leads).select(F.col("cluster").alias("g"), "rep", F.col("rep").alias("comp"), "i", F.lit(0).alias("j"), F.lit(True).alias("new"))
    labels = components(_forest(rows.join(members, "rep"), True))
    if wide.isEmpty():
        return labels
    more = _across(spark, placed.where("blocks > 1").select("rep", "cluster"), labels, members, wide, total)
    return labels if more is None or more.isEmpty() else _merged(labels, more)


def _across(spark: SparkSession, rows: DataFrame, labels: DataFrame, members: DataFrame, wide: DataFrame, total: int) -> DataFrame | None:
    """Links (a, b) between different components of the clusters of several blocks, ``rows`` (rep, cluster)."""
    rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("label", "rep").alias("comp"))
    rows = materialize(spark, rows, "wide-rows")
    per = rows.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.sum("count").alias("size"), F.max(F.struct("count", "comp")).alias("main"))
    parts = per.where("size > main.count").select("cluster", "size", F.col("main.comp").alias("main"), F.expr("size - main.count").alias("n_odd"))
    parts = materialize(spark, parts, "parts")
    kinds = [r[0] for r in parts.select(F.col("n_odd") > BLOCK).distinct().collect()]
    if not kinds:
        return None
    open_ = spread_join(rows, parts, "cluster", "rep", wide, total).withColumn("odd", F.col("comp") != F.col("main"))
    open_ = materialize(spark, open_.select(F.col("cluster").alias("g"), "rep", "comp", "odd", "size", "n_odd"), "open")
    # one block of odd rows: each row of the cluster is sent once more
    sent = _dealt(open_.where(f"n_odd <= {BLOCK}"))
    if True in kinds:
        sent = sent.unionByName(_dealt(_able(spark, open_.where(f"n_odd > {BLOCK}"), members)))
    return _forest(sent.join(members, "rep"), True)


def _able(spark: SparkSession, open_: DataFrame, members: DataFrame) -> DataFrame:
    """Of ``open_`` rows (g, rep, comp, odd, size, n_odd) those that may have a link to another component, with the ends of one kind as ``odd``."""
    full = materialize(spark, open_.select("g", "rep", "comp", "odd").join(members.select("rep", "f1", "text"), "rep"), "full")
    tokens = full.select("g", "f1", "text", "comp").mapInArrow(_tokens, "comp long, token long")
    shared = tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    bits = spark.sparkContext.broadcast(hash_bits(shared))  # of fixed size

    def count(batches):
        for part, sets in _token_sets(batches):
            m = [int(in_bits(bits.value, s).sum()) for s in sets]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (0, 3, 4, 5)), pa.array(m, pa.int64()), pa.array(map(len, sets), pa.int64())], names=["g", "rep", "comp", "odd", "m", "n"])

    # what two sets share is in other components of both; the bitmap may count more, never less
    found = full.select("g", "f1", "text", "rep", "comp", "odd").mapInArrow(count, "g long, rep long, comp long, odd boolean, m long, n long")
    able = found.where("n > 0 AND 4 * m >= 3 * n").groupBy("g", "rep", "comp", "odd").agg(F.max(F.expr("7 * m >= 6 * n")).alias("small"))
    able = materialize(spark, able, "able")
    sides = able.groupBy("g").agg(F.count("*").alias("size"), F.count_if("odd").alias("odds"), F.count_if("small").alias("smalls")).where("odds > 0 AND smalls > 0")
    sides = materialize(spark, sides.select("g", "size", F.expr("odds <= smalls").alias("by_odd"), F.least("odds", "smalls").alias("n_odd")), "sides")
    # a link has an end outside the largest component, and a smaller end: the rarer kind meets all rows
    return spread_join(able, sides, "g", "rep", sides, able.count()).select("g", "rep", "comp", F.expr("IF(by_odd, odd, small)").alias("odd"), "size", "n_odd")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sketches = materialize(spark, sketch(docs), "sketches")
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    best = known.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = materialize(spark, best.select("f1", "f2", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")), "classes")
    # a row number, not doc_id: rows may share one
    reps = sketches.join(classes.select("row"), "row", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "f1", "signature", "bands")
    reps = materialize(spark, reps, "representatives")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).where("rep IS NOT NULL")
    comp = _components(spark, reps, texts).withColumnRenamed("node", "rep")
    classed = classes.join(comp, "rep", "left").select("f1", "f2", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "f1", "f2").join(classed, ["f1", "f2", "n_shingles"], "left")
    alone = F.expr("n_shingles = 0 OR doc_id IS NULL")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id; repeated rows of it become one. All columns stay, whatever their names."""
    with scratch() as kept:
        found = near_duplicates(docs)
        gone = materialize(spark, found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
        several = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
        twice = materialize(spark, several.select(F.col("doc_id").alias("twice")), "twice")
        kept += [gone, twice]
    marked = may_be_in(docs, "doc_id", gone)
    # most rows are surely not among those that go, and stay where they are
    kept = marked.where("NOT hit").select("row").union(marked.where("hit").join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row"))
    if twice.isEmpty():
        return kept.select("row.*")
    again = F.col("row.doc_id") == F.col("twice")
    one = kept.join(twice, again, "left_semi").withColumn("id", F.col("row.doc_id")).withColumn("t", F.col("row.text")).dropDuplicates(["id", "t"])
    return kept.join(twice, again, "left_anti").union(one.select("row")).select("row.*")
