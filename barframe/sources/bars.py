"""Bar tables: schema, readers, admission checks, and bars made from ticks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRICES = ("open", "high", "low", "close")
REQUIRED = ("time", *PRICES, "volume")
#: Optional session flags and the input names that stand for each (fixed values).
FLAG_ALIASES = {
    "session_ismarket": ("session_ismarket", "session_is_market", "ismarket", "is_market"),
    "session_isfirstbar": ("session_isfirstbar", "session_is_first_bar", "isfirstbar", "is_first_bar"),
    "session_islastbar": ("session_islastbar", "session_is_last_bar", "islastbar", "is_last_bar"),
}
BAR_SCHEMA = T.StructType(
    [T.StructField("sym", T.StringType()), T.StructField("time", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]
    + [T.StructField("time_close", T.LongType())]
    + [T.StructField(c, T.BooleanType()) for c in FLAG_ALIASES]
)


def _flag(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "true", "yes", "y", "on"), True).when(text.isin("0", "false", "no", "n", "off", ""), False).otherwise(F.try_to_number(text, F.lit("9")) != 0)


def normalise(df: DataFrame, sym: str = "", time_unit: str = "s", columns: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` in BAR_SCHEMA: renamed by ``columns`` (field -> input name), milliseconds as seconds, NaN as NULL, flag aliases resolved."""
    if time_unit not in ("s", "ms"):
        raise ValueError("time_unit is 's' or 'ms'")
    names = dict(columns or {})
    source = lambda field: names.get(field, field)
    missing = [f for f in REQUIRED if source(f) not in df.columns]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    seconds = lambda c: F.floor(c.cast("double") / (1000 if time_unit == "ms" else 1)).cast("long")
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    out = [F.col(source("sym")).cast("string").alias("sym") if source("sym") in df.columns else F.lit(sym).alias("sym"), seconds(F.col(source("time"))).alias("time")]
    out += [number(F.col(source(f))).alias(f) for f in (*PRICES, "volume")]
    out.append((seconds(F.col(source("time_close"))) if source("time_close") in df.columns else F.lit(None).cast("long")).alias("time_close"))
    for field, aliases in FLAG_ALIASES.items():
        found = [_flag(F.col(a)) for a in (names.get(field), *aliases) if a and a in df.columns]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("boolean")).alias(field))
    return df.select(*out)


def from_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]], sym: str = "", time_unit: str = "s") -> DataFrame:
    rows = [dict(r) for r in rows]
    if not rows:
        return spark.createDataFrame([], BAR_SCHEMA)
    lacking = sorted({f for r in rows for f in REQUIRED if f not in r})
    if lacking:
        raise ValueError(f"bars lack {', '.join(lacking)}")
    fields = list(dict.fromkeys(k for r in rows for k in r))
    kind = lambda f: "string" if f == "sym" or f not in (*REQUIRED, "time_close") else "double"
    cast = lambda f, v: None if v is None else (str(v) if kind(f) == "string" else float(v))
    return normalise(spark.createDataFrame([tuple(cast(f, r.get(f)) for f in fields) for r in rows], ", ".join(f"`{f}` {kind(f)}" for f in fields)), sym, time_unit)


def from_csv(spark: SparkSession, path: str, sym: str = "", time_unit: str = "s", columns: Mapping[str, str] | None = None) -> DataFrame:
    return normalise(spark.read.csv(path, header=True), sym, time_unit, columns)


def from_pandas(spark: SparkSession, pdf, sym: str = "", time_unit: str = "s", **columns: str) -> DataFrame:
    return normalise(spark.createDataFrame(pdf), sym, time_unit, columns)


def read_bars(spark: SparkSession, source, sym: str = "", **options) -> DataFrame:
    """Bars from a DataFrame, a pandas frame, rows, or the path of a CSV, Parquet or JSON file."""
    if isinstance(source, DataFrame):
        return normalise(source, sym, **options)
    if isinstance(source, str):
        if source.rstrip("/").endswith((".parquet", ".orc", ".json")):
            return normalise(spark.read.format(source.rstrip("/").rpartition(".")[2]).load(source), sym, **options)
        return from_csv(spark, source, sym, **options)
    if hasattr(source, "to_dict") and hasattr(source, "columns"):
        return from_pandas(spark, source, sym, **options)
    return from_rows(spark, source, sym, **options)


def from_ticks(ticks: DataFrame, sym: str, ts: str, value: str, every: str, tie: str | list[str], volume: str | Column | None = None) -> DataFrame:
    """OHLCV bars of ``every`` ('hour', 'day', 'week', 'month') from ticks: one shuffle, combined before it.

    Ticks at the same ``ts`` are ordered by ``tie``. Volume is the sum of ``volume``, or the number of ticks.
    """
    order = F.struct(F.col(ts), *([F.col(tie)] if isinstance(tie, str) else map(F.col, tie)))
    amount = F.count("*") if volume is None else F.sum(volume if isinstance(volume, Column) else F.col(volume))
    return (
        ticks.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(sym).alias("sym"), F.unix_timestamp(F.date_trunc(every, F.col(ts))).alias("time"))
        .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), amount.cast("double").alias("volume"))
    )


def check(df: DataFrame, allow_missing: bool = False, unique_times: bool = True) -> DataFrame:
    """``df`` with ``reject``: why a bar isn't admitted, NULL for good ones. One window per symbol."""
    before = F.lag("time").over(Window.partitionBy("sym").orderBy("time"))
    inf = lambda c: F.abs(F.col(c)) == F.lit(float("inf"))
    fields = [*PRICES, "volume"]
    reasons = [F.when(F.col("time").isNull(), "time is missing")]
    reasons += [F.when(inf(f), f"{f} is not finite") for f in fields]
    if not allow_missing:
        reasons += [F.when(F.col(f).isNull(), f"{f} is missing") for f in fields]
    if unique_times:
        reasons.append(F.when(F.col("time") == before, "time repeats"))
    reasons += [
        F.when(F.col("high") < F.col("low"), "high is below low"), F.when(F.col("high") < F.greatest("open", "close"), "high is below open or close"),
        F.when(F.col("low") > F.least("open", "close"), "low is above open or close"), F.when(F.col("volume") < 0, "volume is negative"),
    ]
    return df.withColumn("reject", F.coalesce(*reasons))


def admit(df: DataFrame, strict: bool = False, **rules) -> tuple[DataFrame, DataFrame]:
    """(good bars, quarantined bars with ``reject``). ``strict``: the good bars' plan fails at the first bad one instead."""
    checked = check(df, **rules)
    if strict:
        fine = F.assert_true(F.col("reject").isNull(), F.coalesce("reject", F.lit("")))
        return checked.where(fine.isNull()).drop("reject"), checked.where("false")
    return checked.where("reject IS NULL").drop("reject"), checked.where("reject IS NOT NULL")


def within_budget(df: DataFrame, max_bars: int) -> DataFrame:
    """``df``, or an error where it has more than ``max_bars`` bars; reads no more than it must to tell."""
    if df.limit(max_bars + 1).count() > max_bars:
        raise ValueError(f"more than {max_bars} bars")
    return df


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("time", "sym").limit(n)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc("time"), F.desc("sym")).limit(n).orderBy("time", "sym")


def time_range(df: DataFrame) -> DataFrame:
    return df.groupBy("sym").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("bars"))
