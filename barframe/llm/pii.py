"""Personal data: fixed patterns, widened by bootstrapped contextual extraction.

1. One pass over whole texts finds the base spans (email, ip, card, phone) and the
   *candidates*: tokens of four characters or more that hold a digit or an at sign and
   overlap no base span; identifiers without either are out of its reach. Both are emitted
   as instances with their lexical patterns, the two words before, and the words on both
   sides. Words end at white space and at base spans; long ones count by a hash of the
   whole word. Work grows with a text's length, whatever it holds.
2. Spark scores the bipartite graph of patterns and instances. Base instances have
   score 1. In each round a pattern's confidence is the mean score of its distinct
   instances, provided that at least ``MIN_SEEDS`` of them are trusted; an instance's
   score is the noisy-or of its patterns' confidences, and those over ``TRUST`` count as
   trusted in the next round.
3. Candidates that a pattern of confidence ``CONFIDENT`` or more introduces become
   spans of kind ``context``.

Defined results: null text counts as empty; equal texts have equal spans, so repeated
rows do too; an empty table gives an empty result. ``personal_data`` ignores other columns,
``redact`` keeps them, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .bitmap import may_be_in
from .storage import whole_row

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, MIN_SEEDS, TRUST, CONFIDENT = 3, 5, 0.8, 0.8

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does, so that each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, sought from each at sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


class _Words:
    """Words of a text around its spans: lower-cased, stripped, cut at white space and at base spans."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.text, self.starts, self.ends = text, [s for s, _, _ in spans], sorted(e for _, _, e in spans)

    def before(self, at: int) -> tuple[str, int]:
        """(the word that ends before ``at``, its start)"""
        text, k = self.text, bisect_right(self.ends, at)
        bound = self.ends[k - 1] if k else 0
        while at > bound and text[at - 1] in _SPACES:
            at -= 1
        start = at
        while start > bound and text[start - 1] not in _SPACES:
            start -= 1
        return _key(text[start:at]), start

    def after(self, at: int) -> str:
        k = bisect_left(self.starts, at)
        m = _TOKEN.search(self.text, at, self.starts[k] if k < len(self.starts) else len(self.text))
        return _key(m[0]) if m else ""

    def patterns(self, start: int, end: int) -> list[str]:
        """The contexts of a span: two words before it; the words around it."""
        one, at = self.before(start)
        two, _ = self.before(at)
        out = [f"{two} {one} _"] if one and two else []
        after = self.after(end)
        return out + ([f"{one} _ {after}"] if one and after else [])


def _key(word: str) -> str:
    """A word as a key of bounded length."""
    word = word.strip(_EDGE).lower()
    return word if len(word) <= 40 else "#" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of four characters or more that hold a digit or an at sign and touch no span."""
    out, seen = [], -1
    if not _MARKED.search(text):
        return out
    taken = sorted((s, e) for s, _, e in spans)
    k = 0
    for m in _MARKED.finditer(text):
        if m.start() < seen:
            continue
        start = m.start()
        while start > 0 and text[start - 1] not in _SPACES:
            start -= 1
        seen = end = _TOKEN.match(text, start).end()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= 4 and not any(s < end and e > start for s, e in taken[max(k - 1, 0) : k + 8]):
            out.append((start, end))
    return out


FOUND = "doc_id long, text_key string, spans array<struct<start: int, kind: int, end: int>>, instances array<struct<start: int, end: int, seed: boolean, name: string, patterns: array<string>>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_INSTANCE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("name", pa.string()), ("patterns", pa.list_(pa.string()))]))


def extract(docs: DataFrame) -> DataFrame:
    """FOUND: base spans, and the instances with their patterns, of each row of ``docs`` (doc_id, text)."""

    def find(batches):
        for batch in batches:
            keys, spans, instances = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                near = candidates(text, base)
                words = _Words(text, base)
                # only texts with instances need a key: it joins their learnt spans back
                keys.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if base or near else None)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                instances.append(
                    [{"start": s, "end": e, "seed": True, "name": f"{KINDS[k]} {_key(text[s:e])}", "patterns": words.patterns(s, e)} for s, k, e in base]
                    + [{"start": s, "end": e, "seed": False, "name": _key(text[s:e]), "patterns": words.patterns(s, e)} for s, e in near]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(spans, _SPAN), pa.array(instances, _INSTANCE)], names=["doc_id", "text_key", "spans", "instances"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, FOUND)


def confident_patterns(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Patterns whose instances are mostly trusted: pattern, confidence. ``edges``: pattern, instance, seed, distinct."""
    scores = edges.withColumn("score", F.col("seed").cast("double"))
    for last in (False,) * (ROUNDS - 1) + (True,):
        rated = scores.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= TRUST).alias("trusted"))
        rated = rated.where((F.col("trusted") >= MIN_SEEDS) & (F.col("confidence") > 0.05))
        if last:
            return rated.where(F.col("confidence") >= CONFIDENT).select("pattern", "confidence")
        lifted = edges.where("NOT seed").join(rated, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("lift"))
        scores = storage.materialize(spark, edges.join(lifted, "instance", "left").withColumn("score", F.expr(f"CASE WHEN seed THEN 1D WHEN lift >= {TRUST} THEN lift ELSE 0D END")).drop("lift"), "pattern-graph")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (base), learnt (context spans) of each row of ``docs``; both as arrays of (start, kind, end)."""
    spark = docs.sparkSession
    found = storage.materialize(spark, extract(docs), "pii-found")
    # a text counts once, however often it is repeated
    uses = found.where("size(instances) > 0").select("text_key", F.explode("instances").alias("i")).select("text_key", "i.*")
    edges = uses.select(F.explode("patterns").alias("pattern"), F.col("name").alias("instance"), "seed").distinct()
    strong = confident_patterns(spark, storage.materialize(spark, edges, "pattern-graph"))
    fresh = uses.where("NOT seed").select("text_key", "start", "end", F.explode("patterns").alias("pattern")).distinct().join(strong, "pattern")
    learnt = fresh.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end"))).alias("learnt"))
    none = F.expr("array()").cast(learnt.schema["learnt"].dataType)
    cols = found.select("doc_id", "text_key", "spans")
    # rows without a key have nothing to learn and need no join, where they would all meet in one task
    keyed = cols.where("text_key IS NOT NULL").join(storage.materialize(spark, learnt, "pii-learnt"), "text_key", "left").select("doc_id", "text_key", "spans", F.coalesce("learnt", none).alias("learnt"))
    return keyed.union(cols.where("text_key IS NULL").select("doc_id", "text_key", "spans", none.alias("learnt")))


def _text_of(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def op1_pii_bootstrapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(storage.read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    both = _text_of("array_sort(concat(spans, learnt))")
    return got.select("doc_id", *counts, F.sha2(F.expr(_text_of("spans")), 256).alias("base_sha256"), F.expr(both).alias("spans"), F.expr("bigint(size(learnt))").alias("n_context"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets, and n_chars to match where there is one.

    Overlapping spans become one replacement, named by the first.
    """
    with storage.scratch() as kept:
        found = personal_data(docs).where("size(spans) + size(learnt) > 0")
        # by text, not by doc_id: one row a text, whatever repeats
        spans = found.groupBy("text_key").agg(F.first(F.expr("array_sort(concat(spans, learnt))")).alias("spans"))
        spans = storage.materialize(docs.sparkSession, spans, "pii-spans")
        kept.append(spans)
    rows = may_be_in(docs.select(whole_row(docs).alias("doc"), F.sha2("text", 256).alias("key")), "key", spans.select("text_key"))
    # most texts surely hold nothing, and stay where they are
    sure = rows.where("NOT hit").select("row.doc.*")
    joined = rows.where("hit").join(spans, F.col("row.key") == F.col("text_key"), "left").select("row.doc", "spans")
    kinds = [f"[{k.upper()}]" for k in KINDS]
    schema, names = docs.schema, [c.lower() for c in docs.columns]
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches):
        for batch in batches:
            cols = batch.column(0).flatten()
            texts = cols[at].to_pylist()
            lengths = cols[count].to_pylist() if count is not None else None
            for r, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    parts, done = [], 0
                    for s in spans:
                        if s["start"] >= done:
                            parts += [texts[r][done : s["start"]], kinds[s["kind"]]]
                        done = max(done, s["end"])
                    texts[r] = "".join([*parts, texts[r][done:]])
                    if lengths is not None:
                        lengths[r] = len(texts[r])
            cols[at] = pa.array(texts, cols[at].type)
            if count is not None:
                cols[count] = pa.array(lengths, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return sure.union(joined.mapInArrow(clean, schema))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced."""
    return redact(docs)
