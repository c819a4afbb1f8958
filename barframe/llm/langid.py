"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-cased letters with single spaces between runs of them, after
``ORDER - 1`` start symbols. For each language the counts of ``ORDER``-grams over its
training documents give, by continuation counts, an interpolated Kneser-Ney model: for each
order a sorted array of gram hashes with their log-probabilities, and one of context
hashes with their back-off weights. A batch looks up each of its different grams once in
each language. A text gets the language of the least cross-entropy, a letter or space on
average. A score below ``accept``, which is calibrated on training documents that the
models were not fitted on, marks the row as rejected.

The models are fitted on a bounded sample of labelled rows: ``docs_per_lang``
documents of each language in expectation, chosen by a hash of the identifier,
halved until there are at most ``max_grams`` n-grams of the highest order in all; all labelled
documents take part in the counts that set the rate. Everything else reads all rows; where
the sample is all there is, ``accept`` is taken on it.

Defined results: null text, or text without a letter, is ``und`` with score 0; with no
training rows every row is; a null doc_id is not held out, so its row is a training row;
repeated rows have equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

ORDER, DOCS_PER_LANG, MAX_GRAMS = 4, 1500, 4_000_000
PIECE = 1 << 19
_U = np.uint64
_SLOT = tk._mixed(ORDER, 404) | _U(1)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def symbols(text: str) -> np.ndarray:
    """START, then code points of the letters with one space (32) between and after runs of them; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = codes[keep]
    return np.concatenate([START, out, [32][: int(out[-1] != 32)]]).astype(np.uint32)


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n symbols."""
    if len(s) < n:
        return np.zeros(0, _U)
    w = s.astype(_U)
    m = len(w) - n + 1
    h = w[:m] * _SLOT[0]
    for i in range(1, n):
        h += w[i : m + i] * _SLOT[i]
    return h


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, part of its text): a long text comes in parts so that memory stays bounded; parts are cut at spaces where there are any."""
    for r, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = min(at + PIECE, len(t))
            if end < len(t):
                space = t.rfind(" ", at + PIECE // 2, end)
                end = space if space > 0 else end
            yield r, t[at:end]
            at = end


START = np.full(ORDER - 1, 2, np.uint32)


@dataclass
class Language:
    """By order 1..ORDER: sorted gram hashes and their log-probabilities; by order 2..ORDER (first is empty): sorted context hashes and their log back-off weights."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unknown: float

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> Language:
        """The model of distinct ORDER-grams (rows of code points) and their counts."""
        tables = []
        # highest order: counts; below: the number of different symbols before (continuation counts)
        for order in range(ORDER, 0, -1):
            key, first, inverse = np.unique(grams_of(codes), return_index=True, return_inverse=True)
            table = np.bincount(inverse, counts, len(key))
            codes = codes[first]
            tables.append((key, codes, table))
            counts, codes = np.ones(len(codes)), codes[:, 1:]
        out = cls([], [], [], [], 0.0)
        under_keys, under = np.zeros(0, _U), np.zeros(0)
        for key, sym, table in reversed(tables):
            ones, twos = int((table == 1).sum()), int((table == 2).sum())
            discount = min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5
            # of an only symbol the context is empty, and one hash
            context, at = np.unique(grams_of(sym[:, :-1]), return_inverse=True)
            total, kinds = np.bincount(at, table, len(context)), np.bincount(at, minlength=len(context))
            rest = discount * kinds / total
            if sym.shape[1] == 1:
                lower = np.full(len(key), 1.0 / 65536)
                out.unknown = float(np.log(rest[0] / 65536))
                context, rest = np.zeros(0, _U), np.zeros(0)
                p = (table - discount) / total[0] + discount * kinds[0] / total[0] * lower
            else:
                lower = under[np.searchsorted(under_keys, grams_of(sym[:, 1:]))]
                p = (table - discount) / total[at] + rest[at] * lower
            out.keys.append(key)
            out.logp.append(np.log(p).astype(np.float32))
            out.contexts.append(context)
            out.backoff.append(np.log(rest).astype(np.float32))
            under_keys, under = key, p
        return out

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place) of hashes in sorted ``keys``."""
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return keys[at] == h, at

    def costs(self, grams_by_order: list[np.ndarray], contexts_by_order: list[np.ndarray]) -> np.ndarray:
        """Negative log-probability of the last symbol of each ORDER-gram, given hashes of its ends and of their contexts."""
        n = len(grams_by_order[-1])
        out, weight, todo = np.empty(n), np.zeros(n), np.arange(n)
        for order in range(ORDER, 0, -1):
            hit, at = self._find(self.keys[order - 1], grams_by_order[order - 1][todo])
            out[todo[hit]] = self.logp[order - 1][at[hit]] + weight[todo[hit]]
            todo = todo[~hit]
            if order > 1:
                # the context that this order used, if it is known, passes its weight on
                hit, at = self._find(self.contexts[order - 1], contexts_by_order[order - 1][todo])
                weight[todo[hit]] += self.backoff[order - 1][at[hit]]
        out[todo] = self.unknown + weight[todo]
        return -out


@dataclass
class Model:
    langs: list[str]
    models: list[Language]
    accept: float = 0.0

    def costs(self, s: np.ndarray) -> np.ndarray:
        """(positions, languages) costs of the symbols of s after the first ORDER - 1, each in the context of those before it."""
        whole, first, inverse = np.unique(grams(s, ORDER), return_index=True, return_inverse=True)
        codes = s[first[:, None] + np.arange(ORDER)]
        ends = [grams_of(codes[:, ORDER - n :]) for n in range(1, ORDER)] + [whole]
        contexts = [grams_of(codes[:, ORDER - n : -1]) for n in range(1, ORDER + 1)]
        return np.stack([m.costs(ends, contexts)[inverse] for m in self.models], 1)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(total cost in nats of each row in each language, symbols of each row)"""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal group, size
            if group:
                cost = self.costs(np.concatenate([x for _, x in group]))
                cuts = np.cumsum([0, *(len(x) for _, x in group)])[:-1]
                # grams that reach into the next part's start symbols are of no part
                for i in range(1, ORDER):
                    cost[(cuts[1:] - i)] = 0
                for (r, x), c in zip(group, np.add.reduceat(cost, cuts, axis=0), strict=True):
                    total[r] += c
                    count[r] += len(x) - ORDER + 1
            group, size = [], 0

        for r, t in _pieces(texts):
            s = symbols(t)
            if len(s):
                group.append((r, s))
                size += len(s)
                if size > PIECE:
                    flush()
        flush()
        return total, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 - exp(-margin) with the margin in nats a symbol, times 20; ``und`` scores 0."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, count = self.entropies(texts)
        mean = total / np.maximum(count, 1)[:, None]
        best = mean.argmin(1)
        two = np.partition(mean, 1, axis=1)[:, :2] if len(self.langs) > 1 else np.column_stack([mean[:, 0], mean[:, 0] + 1])
        score = np.where(count > 0, 1 - np.exp(-20 * (two[:, 1] - two[:, 0])), 0.0)
        return [self.langs[b] if c else "und" for b, c in zip(best, count, strict=True)], score


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols, as ``grams`` hashes a run."""
    h = np.zeros(len(codes), _U)
    for i in range(codes.shape[1]):
        h += codes[:, i].astype(_U) * _SLOT[i]
    return h


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang number, text): (lang number, gram, count) of each piece."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for r, t in _pieces(batch.column(1).to_pylist()):
            s = symbols(t)
            if not len(s):
                continue
            key, first, counts = np.unique(grams(s, ORDER), return_index=True, return_counts=True)
            found = np.lib.stride_tricks.sliding_window_view(s, ORDER)[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), langs[r], np.int32)), pa.array([g.tobytes() for g in found], pa.binary()), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


_LUCK = "pmod(xxhash64(doc_id), 1000003) / 1000003D"


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, max_grams: int = MAX_GRAMS) -> tuple[Model, Column]:
    """(model fitted on ``docs`` (doc_id, text, lang; only training rows), whether a row of ``docs`` was in its sample)."""
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], []), F.lit(False)
    number = F.create_map(*(x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))))[F.col("lang")]
    rate = docs_per_lang
    while True:
        share = F.create_map(*(x for name in langs for x in (F.lit(name), F.lit(min(1.0, rate / sizes[name])))))[F.col("lang")]
        sampled = F.coalesce(F.expr(_LUCK) < share, F.lit(False))
        texts = known.where(sampled).select(number.alias("lang"), F.col("text").cast("string"))
        counted = storage.materialize(spark, texts.mapInArrow(_count_grams, "lang int, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        if counted.count() <= max_grams or rate < 1:
            break
        rate /= 2
    rows = counted.toArrow().combine_chunks()  # max_grams rows at most
    storage.discard(counted)
    codes = np.frombuffer(b"".join(rows["gram"].to_pylist()), np.uint32).reshape(-1, ORDER)
    lang, n = rows["lang"].to_numpy(), rows["n"].to_numpy().astype(float)
    seen = [i for i in range(len(langs)) if (lang == i).any()]  # a language whose texts hold no letter has no model
    return Model([langs[i] for i in seen], [Language.fit(codes[lang == i], n[lang == i]) for i in seen]), sampled


def _predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but text, with lang_pred and score."""
    rest = [f for f in docs.schema if f.name != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_grams rows of every order at most

    def predict(batches):
        own = sent.value
        for batch in batches:
            langs, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in rest), "lang_pred", "score"])

    return docs.mapInArrow(predict, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string", "score double"]))


def identify(docs: DataFrame, training: Column, docs_per_lang: int = DOCS_PER_LANG, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, training, lang_pred, score, rejected for each row of ``docs`` (doc_id, text, lang); ``training``: the rows to learn from."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang", training.alias("training"))
    model, sampled = train(rows.where("training"), docs_per_lang, max_grams)
    # what is told apart by lang here only sets the threshold
    marked = rows.select("doc_id", "training", F.when(F.col("training"), F.col("lang")).alias("truth"), (F.col("training") & sampled).alias("sampled"), "text")
    out = storage.materialize(docs.sparkSession, _predict(marked, model).withColumn("score", F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), 9)), "languages")
    # reject what scores lower than all but one in a thousand of the rightly named texts that the models don't know
    low = [F.percentile_approx(F.when(c, F.col("score")), 0.001, 1000) for c in (~F.col("sampled"), F.col("sampled"))]
    fresh, fitted = out.where("training AND lang_pred = truth").agg(*low).first()
    accept = fresh if fresh is not None else fitted if fitted is not None else 0.0
    return out.select("doc_id", "training", "lang_pred", "score", (F.col("score") < accept).alias("rejected"))


def op9_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs, ~held).select("doc_id", (~F.col("training")).alias("held_out"), "lang_pred", "score", "rejected")
