"""What surrounds bars: symbols, sessions, requests, and conditions that must hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import BarFrame, truthy

#: Facts of a symbol and what they are where nothing is known (fixed values).
SYMBOL = {
    "ticker": "", "tickerid": "", "prefix": "", "currency": "", "basecurrency": "",
    "mintick": 1.0, "pointvalue": 1.0, "type": "", "timezone": "", "volumetype": "",
}
SYMBOL_ROW = "sym string, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in SYMBOL.items())


def symbol(facts: str | Mapping | None = None) -> dict:
    """All facts of a symbol from some: an identifier ``PREFIX:TICKER``, or a mapping with or without one."""
    given = {"tickerid": facts} if isinstance(facts, str) else dict(facts or {})
    if unknown := set(given) - set(SYMBOL):
        raise KeyError(f"symbols have no {', '.join(sorted(unknown))}")
    prefix, _, ticker = str(given.get("tickerid", "")).rpartition(":")
    own = SYMBOL | {"prefix": prefix, "ticker": ticker} | given
    joined = ":".join(p for p in (own["prefix"], own["ticker"]) if p)
    return own | {"tickerid": own["tickerid"] or joined}


def symbols(spark: SparkSession, facts: Mapping[str, str | Mapping | None]) -> DataFrame:
    """A table of symbols, by their name in the bars."""
    return spark.createDataFrame([{"sym": s} | symbol(f) for s, f in facts.items()], SYMBOL_ROW)


def with_symbols(bf: BarFrame, table: DataFrame, *facts: str) -> BarFrame:
    """Facts of its symbol beside each bar; what isn't known is as in SYMBOL."""
    side = table.select("sym", *(F.col(f).alias(f"_{f}") for f in facts))
    joined = bf.df.join(side, "sym", "left")
    return BarFrame(joined.withColumns({f: F.coalesce(f"_{f}", F.lit(SYMBOL[f])) for f in facts}).drop(*(f"_{f}" for f in facts)), bf.keys, bf.order)


def session_state(bf: BarFrame) -> BarFrame:
    """ismarket, isfirstbar, islastbar: columns of the bars where they are, else an open market and a symbol's first and last bar."""
    have = {c.lower() for c in bf.df.columns}
    state = bf.bar_state()
    plain = {"ismarket": F.lit(True), "isfirstbar": F.col("isfirst"), "islastbar": F.col("islast")}
    return state.with_columns(**{k: F.coalesce(F.col(k).cast("boolean"), v) if k in have else v for k, v in plain.items()}).keep(bf, *plain)


def fail_when(bf: BarFrame, condition: Column, message: str) -> BarFrame:
    """The bars, or an error of the query that reads one where ``condition`` holds."""
    return BarFrame(bf.df.where(F.assert_true(~truthy(condition), F.lit(message)).isNull()), bf.keys, bf.order)


def finalized_through(requested: BarFrame, step: int, now: Column | int) -> DataFrame:
    """sym, through: the time up to which requested bars have closed by ``now``."""
    now = F.lit(now) if isinstance(now, int) else now
    closed = F.col(requested.order) + step <= now
    return requested.df.where(closed).groupBy("sym").agg((F.max(requested.order) + step).alias("through"))


def request_report(chart: BarFrame, requested: BarFrame, chart_step: int, requested_step: int) -> DataFrame:
    """sym, chart_bars, requested_bars, without (chart bars before the first requested one has closed), through (the last close)."""
    delay = max(requested_step - chart_step, 0)
    side = requested.df.groupBy("sym").agg(F.count("*").alias("requested_bars"), (F.min(requested.order) + delay).alias("_seen"), (F.max(requested.order) + requested_step).alias("through"))
    rows = chart.df.select("sym", chart.order).join(side.select("sym", "_seen"), "sym", "left")
    counts = rows.groupBy("sym").agg(F.count("*").alias("chart_bars"), F.count_if(F.col("_seen").isNull() | (F.col(chart.order) < F.col("_seen"))).alias("without"))
    out = counts.join(side.drop("_seen"), "sym", "left")
    return out.select("sym", "chart_bars", F.coalesce("requested_bars", F.lit(0)).alias("requested_bars"), "without", "through")
