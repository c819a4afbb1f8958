"""Quality rules: base rules plus an isolation forest on rule statistics.

``rule_statistics`` reads each whole text. ``IsolationForest`` grows random splits on a
bounded sample (``trees * subsample`` rows at most, the least hashes of identifier and
statistics); anomalous rows have short paths. ``calibrate`` reads all labelled rows as
a histogram of scores and picks the threshold that costs least.

Defined results: null text counts as empty (no words, ``base_failed``); repeated
rows give repeated rows; with no labelled rows, or none whose junk stands apart,
the threshold is above every score and only the base rules reject; an empty table
gives an empty result. ``assess`` ignores other columns; ``quality_stage`` keeps them,
whatever their names, and judges each row by its own text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .storage import materialize, read_table, scratch

#: Rates, so that short and long texts compare; the length itself is left to the base rules.
#: Symbols are seen in several ways, so that a split on them is drawn often; what repeats is one feature, as ordinary prose repeats too.
FEATURES = ("f_word_len", "f_symbols", "f_symbol_words", "f_symbol_chars", "f_marks", "f_repetition", "f_upper", "f_shout")
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES)


def _byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _SHOUT, _MARKS = map(_byte_class, ("#*$%&|<>", "!?", "#*$%&|<>!?=~^_@"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeat_words(hashes: np.ndarray, rows: np.ndarray, size: int = 8) -> np.ndarray:
    """Words of each row in ``size``-word windows that the row holds twice or more."""
    h, at, cuts = tk.runs(hashes, rows, size)
    if not len(h):
        return np.zeros(len(rows) - 1, np.int64)
    owner = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(cuts))
    key = tk.mix(h ^ (owner * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(h), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[at[found]] += 1
    edge[at[found] + size] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return tk.row_sums(covered, rows)


def _words_with(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each row that hold a byte of the class."""
    if not len(starts):
        return np.zeros(len(rows) - 1, np.int64)
    first = int(starts[0])
    seen = np.concatenate([[0], np.cumsum(table[data[first : int(ends[-1])]])])
    return tk.row_sums(seen[ends - first] > seen[starts - first], rows)


def _same_words(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each row that equal the word before them."""
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[rows[:-1][rows[:-1] < len(hashes)]] = False
    return tk.row_sums(same, rows)


def _measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, rows = tk.words(data, off)
    hashes = tk.word_hashes(data, starts, ends)
    part = data[off[0] : off[-1]]
    count = lambda table: tk.row_sums(table[part], off)
    over = lambda rate: np.maximum(rate - 0.1, 0)  # noqa: E731  what ordinary prose has too says nothing
    n_words = np.diff(rows)
    chars = tk.row_sums(_LEAD[part] & ~tk._SPACE[part], off)
    symbols, repeats = count(_SYMBOLS), _repeat_words(hashes, rows)
    raw = part.tobytes()
    dups = np.array([_duplicate_lines(raw[a:b]) for a, b in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)], np.int64)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats,
        "f_word_len": np.minimum(chars / per_word, 40), "f_symbols": np.log1p(10 * symbols / per_word), "f_symbol_words": _words_with(_SYMBOLS, data, starts, ends, rows) / per_word,
        "f_symbol_chars": symbols / per_char, "f_marks": over(np.minimum(count(_MARKS) / per_word, 2)), "f_repetition": np.maximum(over(repeats / per_word), over(_same_words(hashes, rows) / per_word)),
        "f_upper": over(count(_UPPER) / per_char), "f_shout": np.minimum(count(_SHOUT) / per_word, 2),
    }


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of ``docs`` (doc_id, text)."""

    def measure(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in tk.slices(off):
                got = _measure(data, off[i : j + 1])
                cols = [pa.array(got[n].astype(np.float64 if n[:2] == "f_" else np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, SCHEMA)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3)
    return np.where(big, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, out)


@dataclass
class IsolationForest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right is left + 1), and a leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = 128, subsample: int = 256, seed: int = 7) -> IsolationForest:
        """Each tree takes up to ``subsample`` of the rows; values are split uniformly between a node's least and greatest."""
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        shape = (trees, 2 ** (depth + 1) + 1)
        out = cls(np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape), float(max(_mean_path(size), 1e-9)))
        for t in range(trees):
            used = 1
            todo = [(0, rows[rng.choice(len(rows), size, replace=False)] if size else rows, 0)]
            while todo:
                node, part, level = todo.pop()
                wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else ()
                if level >= depth or not len(wide):
                    out.path[t, node] = level + float(_mean_path(len(part)))
                    continue
                f = int(rng.choice(wide))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                low = part[:, f] <= cut
                out.feature[t, node], out.value[t, node], out.left[t, node] = f, cut, used
                todo += [(used, part[low], level + 1), (used + 1, part[~low], level + 1)]
                used += 2
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 anomalous, under 0.5 ordinary."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (rows[every, np.maximum(f, 0)] > value[node])
                node = np.where(inner, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


#: Score histogram: [0, 1] in steps of 1 / BINS.
BINS = 2000


#: A good row lost costs as much as so many bad rows let through.
LOST = 2


def calibrate(counts: list[tuple[int, int, int]], lost: float = LOST) -> float:
    """The threshold of least cost on the labelled rows, the higher one of equals.

    ``counts``: (score bin, good rows, bad rows). A bad row below the threshold costs 1,
    a good row at or above it ``lost``; 2.0 (nothing is rejected) where no bin costs less than that.
    """
    cost = least = sum(x for _, _, x in counts)
    best = 2.0
    for b, g, x in sorted(counts, reverse=True):
        cost += lost * g - x
        if cost < least:
            best, least = b / BINS, cost
    return best


def verdict(docs: DataFrame, labels: DataFrame, trees: int = 128, subsample: int = 256) -> tuple[DataFrame, IsolationForest, float]:
    """(doc_id, the rule statistics, base_failed and anomaly of each row of ``docs``; the forest; its threshold).

    ``labels``: doc_id, quality (0 bad, 1 good); rows with other values are ignored,
    and an identifier labelled both ways counts as good.
    """
    spark = docs.sparkSession
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = materialize(spark, rule_statistics(docs).withColumn("base_failed", failed), "rule-statistics")
    usual = stats.where("NOT base_failed")
    size = trees * subsample
    luck = F.xxhash64("doc_id", "n_words", "word_chars", *FEATURES)
    # about twice the rows that are wanted pass the hash, so that few are sorted, whatever the number of tasks; rows that repeat are cut by the limit
    share = min(1.0, 2 * size / max(usual.count(), 1))
    lucky = usual.withColumn("luck", luck).where(F.expr(f"pmod(luck, 1000003) < {share} * 1000003"))
    sample = lucky.orderBy("luck", "doc_id", *FEATURES).limit(size).select(*FEATURES).toPandas().to_numpy(float)
    forest = IsolationForest.fit(sample.reshape(-1, len(FEATURES)), trees, subsample)
    scored = _score(stats, forest)
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    binned = (
        scored.where("NOT base_failed").join(marks, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"))
        .agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad"))
    )
    return scored, forest, calibrate([tuple(map(int, r)) for r in binned.collect()])  # BINS + 1 rows at most


def assess(docs: DataFrame, labels: DataFrame, trees: int = 128, subsample: int = 256) -> DataFrame:
    """doc_id, the rule statistics, anomaly (score), threshold, base_failed and kept for each row of ``docs``."""
    scored, _, threshold = verdict(docs, labels, trees, subsample)
    return scored.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def _scores(forest: IsolationForest, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([forest.score(rows[i : i + 4096]) for i in range(0, len(rows), 4096)] or [np.zeros(0)])


def _score(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    # nodes of the forest: trees * 2 * subsample at most, whatever the input's size
    def score(batches):
        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(f)) for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            keep = [n for n in batch.schema.names if n not in FEATURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(_scores(forest, rows))], names=[*keep, "anomaly"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name not in FEATURES]
    return stats.mapInArrow(score, ", ".join([*kept, "anomaly double"]))


def keep_good(docs: DataFrame, forest: IsolationForest, threshold: float) -> DataFrame:
    """The rows of ``docs`` that rules and forest keep, in one pass over their texts."""
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        for batch in batches:
            data, off = tk.utf8(batch.column(at))
            for i, j in tk.slices(off):
                got = _measure(data, off[i : j + 1])
                n = got["n_words"]
                good = (n >= MIN_WORDS) & (100 * got["n_repeat_words"] <= MAX_REPEAT_PERCENT * n)
                good &= _scores(forest, np.column_stack([got[f].astype(float) for f in FEATURES])) < threshold
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("anomaly", 9).alias("anomaly"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the forest keep. Texts are read twice and never shuffled."""
    with scratch():
        _, forest, threshold = verdict(docs, read_table(spark, sf_dir, "labels"))
    return keep_good(docs, forest, threshold)
