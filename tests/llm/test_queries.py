"""The registered queries themselves, over the whole smallest tables, against plain Python."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import base_brute, components_brute, edf_brute, rules_brute, secrets_brute

from barframe.llm import mixing, mpegts, packing, pii, quality
from barframe.llm.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def source(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    query = {k.split("_")[0]: q for k, q in queries().items()}[name]
    return query(spark, DATA).collect()


def shown(found, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, source):
    got = rows(spark, "op1")
    assert len(got) == len(source)
    for r in got:
        base = base_brute(source[r.doc_id].text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == sha(shown(base, pii.KINDS))
        assert [s for s in r.spans.split(",") if s and not s.startswith("context")] == [s for s in shown(base, pii.KINDS).split(",") if s]
        assert r.spans.count("context:") == r.n_context


def test_op1_learnt_spans_equal_the_graph_in_python(spark, source):
    """Rounds of scores over dictionaries, from the extracted instances."""
    found = pii.extract(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    edges = {(p, i.name): i.seed for r in found for i in r.instances for p in i.patterns}
    score = {k: float(seed) for k, seed in edges.items()}
    for last in (False,) * (pii.ROUNDS - 1) + (True,):
        by = defaultdict(list)
        for (p, _), s in score.items():
            by[p].append(s)
        rated = {p: sum(v) / len(v) for p, v in by.items() if sum(x >= pii.TRUST for x in v) >= pii.MIN_SEEDS and sum(v) / len(v) > 0.05}
        if last:
            break
        lift = defaultdict(float)
        for (p, i), seed in edges.items():
            if not seed and p in rated:
                lift[i] += math.log1p(-min(rated[p], 0.999))
        score = {(p, i): 1.0 if seed else (1 - math.exp(lift[i]) if i in lift and 1 - math.exp(lift[i]) >= pii.TRUST else 0.0) for (p, i), seed in edges.items()}
    strong = {p for p, c in rated.items() if c >= pii.CONFIDENT}
    want = Counter(r.doc_id for r in found for i in r.instances if not i.seed and strong & set(i.patterns))
    assert {r.doc_id: r.n_context for r in rows(spark, "op1") if r.n_context} == dict(want)


def test_op2(spark, source):
    got = rows(spark, "op2")
    assert len(got) == len(source)
    for r in got:
        found = secrets_brute(source[r.doc_id].text or "")
        text = shown(found, ("assign", "access", "hex"))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in found) for i in range(3)) and r.spans == text and r.base_sha256 == sha(text)


def test_op3(spark, source):
    ids = sorted(source)
    want = components_brute([source[i].text for i in ids])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op3")}
    assert got == {i: (want[k][0], ids[want[k][1]], want[k][1] == k) for k, i in enumerate(ids)}


def test_op4(spark, source):
    tok = pytest.importorskip("tokenizers")
    plain = tok.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    got, at = {r.doc_id: r for r in rows(spark, "op4")}, 0
    for i in sorted(source):
        ids = [*plain.encode(source[i].text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(source)


def test_op5(spark, source):
    got = rows(spark, "op5")
    assert len(got) == len(source)
    for r in got:
        raw = (source[r.doc_id].text or "").encode()
        payload = raw.ljust(max(64, -len(raw) // 64 * -64), b"\0")
        media = mpegts.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_op6(spark, source):
    got = rows(spark, "op6")
    want = {(i, k): min(packing.CAPACITY, len(r.text) - k * packing.CAPACITY) for i, r in source.items() if r.text for k in range(-(-len(r.text) // packing.CAPACITY))}
    assert {(r.doc_id, r.piece): r.size for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.size
        assert at <= packing.CAPACITY and max(Counter(r.source for r in parts).values()) <= packing.MAX_SAME_SOURCE
        plain = ["".join((source[r.doc_id].text or "").lower().split()) for r in parts if r.piece == 0]
        assert len(set(plain)) == len(plain)


def test_op8(spark, source):
    got = rows(spark, "op8")
    assert len(got) == len(source)
    for r in got:
        n, chars, symbols, dups, repeats = rules_brute(source[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.base_failed and r.kept)


def test_op8_verdict_equals_a_walk_of_the_trees(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    _, forest, threshold = quality.verdict(docs, labels)

    def path(tree, x):
        node, steps = 0, 0
        while forest.feature[tree, node] >= 0:
            node = forest.left[tree, node] + (x[forest.feature[tree, node]] > forest.value[tree, node])
            steps += 1
        assert forest.path[tree, node] >= steps
        return forest.path[tree, node]

    stats = {r.doc_id: r for r in quality.rule_statistics(docs).collect()}
    for r in rows(spark, "op8"):
        x = [stats[r.doc_id][f] for f in quality.FEATURES]
        anomaly = 2 ** (-sum(path(t, x) for t in range(len(forest.feature))) / len(forest.feature) / forest.norm)
        assert abs(anomaly - r.anomaly) < 1e-8 and r.kept == (not r.base_failed and anomaly < threshold)
    # no threshold on the labelled rows costs less
    marks = {r.doc_id: r.quality for r in labels.where("quality IN (0, 1)").collect()}
    judged = [(r.anomaly, marks[r.doc_id]) for r in rows(spark, "op8") if r.doc_id in marks and not r.base_failed]
    cost = lambda t: sum(1 if q == 0 and a < t else quality.LOST if q == 1 and a >= t else 0 for a, q in judged)
    assert cost(threshold) <= min(cost(b / quality.BINS) for b in range(quality.BINS + 1))


def test_op10(spark, source):
    got = rows(spark, "op10")
    sizes = Counter()
    for r in source.values():
        sizes["-" if r.source is None else f"+{r.source}"] += max(len(r.text or ""), 1)
    blocks = {s: -(-n // mixing.BLOCK_CHARS) for s, n in sorted(sizes.items())}
    shares = mixing.tickets({s: sizes[s] ** mixing.POWER for s in blocks})
    slot_of = {x: t for t, x in enumerate(edf_brute(shares, blocks)) if x is not None}
    assert len(got) == len(source)
    by = defaultdict(list)
    for r in got:
        s = "-" if r.source is None else f"+{r.source}"
        assert r.slot == slot_of[s, r.block] and r.block == r.place // mixing.BLOCK_CHARS
        by[s].append(r)
    for own in by.values():  # the documents of a source stand end to end
        at = 0
        for r in sorted(own, key=lambda r: (r.place, r.doc_id)):
            assert r.place == at
            at += max(len(source[r.doc_id].text or ""), 1)


def test_pipeline_equals_plain_python(spark, source, monkeypatch):
    """Rules, components, redaction, schedule and packing rebuilt; the forest's verdicts and row hashes are taken from their operators."""
    import corpus_pipeline

    monkeypatch.setattr(packing, "GROUP_PIECES", 64)
    monkeypatch.setattr(packing, "CAPACITY", 3000)
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 5000)
    monkeypatch.setattr(packing.pack, "__defaults__", (3000, packing.MAX_SAME_SOURCE, 64))
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, 5000, mixing.CHUNK))
    out = corpus_pipeline.run(spark, DATA).collect()

    verdict = {r.doc_id: r.kept for r in rows(spark, "op8")}
    good = [i for i in sorted(source) if verdict[i]]
    groups = components_brute([source[i].text for i in good])
    single = [i for k, i in enumerate(good) if groups[k][1] == k]
    assert len(single) < len(good) < len(source)
    left = spark.createDataFrame([(i, source[i].text, source[i].source) for i in single], "doc_id long, text string, source string")
    text = {}
    for r in pii.personal_data(left).collect():
        old, done, new = source[r.doc_id].text, 0, ""
        for start, kind, end in sorted(map(tuple, [*r.spans, *r.learnt])):
            if start >= done:
                new += old[done:start] + f"[{pii.KINDS[kind].upper()}]"
            done = max(done, end)
        text[r.doc_id] = new + old[done:]
    clean = spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")
    row = {r.doc_id: r for r in clean.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).withColumn("b", F.expr(f"pmod(xxhash64(h, 77), {mixing.BUCKETS})")).collect()}

    by = defaultdict(list)
    for i in text:
        by[source[i].source or ""].append(i)
    place, sizes = {}, {}
    for s, own in by.items():
        at = 0
        for i in sorted(own, key=lambda i: (row[i].b, row[i].h)):
            place[i] = at
            at += max(len(text[i]), 1)
        sizes[s] = at
    shares = mixing.tickets({s: sizes[s] ** mixing.POWER for s in sorted(sizes)})
    slots = {x: t for t, x in enumerate(edf_brute(shares, {s: -(-sizes[s] // 5000) for s in sorted(sizes)})) if x is not None}
    order = sorted(text, key=lambda i: (slots[source[i].source or "", place[i] // 5000], place[i], row[i].h))

    want = Counter()
    for g in range(0, len(order), 64):
        pieces = [(len(text[i][k : k + 3000]), row[i].h, k, i) for i in order[g : g + 64] for k in range(0, len(text[i]), 3000)]
        bins = [[p] for p in pieces if p[0] == 3000]
        whole = len(bins)
        for p in sorted((p for p in pieces if p[0] < 3000), key=lambda p: (-p[0], p[1], p[2])):
            same = lambda b, p=p: sum(source[q[3]].source == source[p[3]].source for q in b)
            fits = [(3000 - sum(q[0] for q in b), n) for n, b in enumerate(bins) if n >= whole and sum(q[0] for q in b) + p[0] <= 3000 and same(b) < 2 and p[3] not in {q[3] for q in b}]
            if fits:
                bins[min(fits)[1]].append(p)
            else:
                bins.append([p])
        want.update((tuple(p[3] for p in b), "".join(text[p[3]][p[2] : p[2] + 3000] for p in b)) for b in bins)
    assert Counter((tuple(r.doc_ids), r.text) for r in out) == want
