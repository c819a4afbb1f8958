"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

A blob is a text's SHA-256. The ledger holds, for each blob and rule version that
was scanned, the findings. A scan content-addresses every version of every path,
takes the blobs for which the ledger lacks some rule version, reads one copy of
each, appends, and joins the findings back to all paths.

Positions come from the pieces between matches: piece and match lengths in code
points, summed in order, within runs of about the square root of their number and then
over runs, so that a text of very many matches takes little more than its length. A
finding keeps its rule's key: other rules in other places don't change its meaning.

Defined results: null text counts as empty; equal texts share one ledger entry;
repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost non-overlapping matches are candidates; ``keep``: SQL over m (the match) and g (its last group) that keeps one."""

    kind: str
    version: str
    pattern: str
    group: int
    keep: str

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values. A run of [A-Z0-9] or [0-9a-f] is one match whatever its length, so the
#: least lengths of `access` and `hex` can stand in the patterns; that of `assign` cannot.
RULES = (
    Rule("assign", "1", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, "length(g) >= 12"),
    Rule("access", "1", r"(AKIA[A-Z0-9]{14,})", 1, "true"),
    Rule("hex", "1", r"([0-9a-f]{16,})", 1, "true"),
)

FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("findings", FINDINGS)])


def _running(values: str) -> str:
    """SQL: the sums of the values before each, of an array that is named once."""
    sums = "(s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at))"
    begin = "named_struct('at', 0, 'out', cast(array() AS array<int>))"
    add = "aggregate({}, 0, (s, x) -> s + x)"
    # each step of a run copies the run, so runs are short
    runs = f"transform(sequence(0, int((size(v) - 1) div n)), r -> slice(v, r * n + 1, n))"
    heads = f"aggregate(transform(runs, r -> {add.format('r')}), {begin}, {sums}, s -> s.out)"
    within = f"flatten(zip_with(runs, heads, (r, h) -> aggregate(r, named_struct('at', h, 'out', cast(array() AS array<int>)), {sums}, s -> s.out)))"
    bound = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    return bound("v", values, bound("n", "int(greatest(1, sqrt(size(v))))", bound("runs", runs, bound("heads", heads, within))))


def _matches(rule: Rule) -> Column:
    """Kept matches of a rule in ``text``, as FINDINGS."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    whole, groups, pieces = f"regexp_extract_all(text, '{pattern}', 0)", f"regexp_extract_all(text, '{pattern}', {rule.group})", f"split(text, '{pattern}', -1)"
    # gap, match, gap, match, ...: there is one gap more
    lengths = f"flatten(zip_with({pieces}, {whole}, (p, m) -> array(length(p), coalesce(length(m), 0))))"
    # m: the match; g: its group; where it starts stands at every second place
    starts = f"filter({_running(lengths)}, (x, i) -> i % 2 = 1)"
    rows = f"zip_with(zip_with({whole}, {groups}, (m, g) -> named_struct('m', m, 'g', g)), {starts}, (x, at) -> named_struct('m', x.m, 'g', x.g, 'at', at))"
    keep = rule.keep.replace("(g)", "(x.g)").replace("(m)", "(x.m)")
    found = f"transform(filter({rows}, x -> x.m IS NOT NULL AND ({keep})), x -> named_struct('start', x.at, 'rule', '{rule.key}', 'end', x.at + length(x.m)))"
    return F.when(F.expr(f"rlike(text, '{pattern}')"), F.expr(found)).otherwise(F.array().cast(FINDINGS))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rules, findings for each row of ``blobs`` (blob, text, due: keys of the rules to run)."""
    none = F.array().cast(FINDINGS)
    parts = [F.when(F.array_contains("due", r.key), _matches(r)).otherwise(none) for r in rules]
    return blobs.select("blob", F.col("due").alias("rules"), F.concat(*parts).alias("findings"))


class Ledger:
    """Append-only Parquet folder of LEDGER rows; a scan's rows land with one job's commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, findings of each row of ``versions`` (path, text), after bringing the ledger up to date.

    Findings are those of ``rules`` in their present versions, sorted by start, then in the order of the rules.
    """
    keys = F.array(*(F.lit(r.key) for r in rules))
    spark = versions.sparkSession
    named = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = storage.materialize(spark, named.select("path", "blob"), "addressed")
    seen = ledger.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # a rule version a row at most
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
    due = blobs.withColumn("due", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where("size(due) > 0").drop("seen")
    # one copy of each blob; repeated rows of the same path are dropped after the scan
    copies = named.withColumnRenamed("path", "_path").withColumnRenamed("blob", "_blob").join(due.hint("shuffle_hash"), F.expr("_path <=> path AND _blob = blob")).select("blob", "text", "due")
    ledger.append(scan_blobs(copies, rules).dropDuplicates(["blob"]))
    # an old version's findings may stand beside the new one's
    known = ledger.rows().select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
    known = known.select("blob", F.struct("f.start", F.array_position(keys, F.col("f.rule")).cast("int").alias("place"), "f.rule", "f.end").alias("f"))
    # written, so that the join below is one of plain shuffles and a blob of very many paths can be split
    ordered = F.transform(F.array_sort(F.collect_set("f")), lambda f: F.struct(f["start"].alias("start"), f["rule"].alias("rule"), f["end"].alias("end")))
    found = storage.materialize(spark, known.groupBy("blob").agg(ordered.alias("findings")), "findings")
    out = addressed.join(found, "blob", "left")
    return out.select("path", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _text_of(findings: str) -> str:
    return f"array_join(transform({findings}, s -> concat(substring_index(s.rule, '@', 1), ':', s.start, ':', s.end)), ',')"


def op2_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    got = scan(docs, Ledger(spark, storage.new_folder(spark, "secret-ledger")))
    counts = [F.expr(f"bigint(size(filter(findings, s -> s.rule = '{r.key}')))").alias(f"n_{r.kind}") for r in RULES]
    spans = F.expr(_text_of("findings"))
    return got.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
