"""Registered queries of streams: the batch queries' columns from step classes, bar by bar, against the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drawing, output, recursive, steps, strategy, ta
from ..operators.frame import BarFrame
from ..streaming import live
from ..streaming.replay import replay
from . import catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

X, C, HLC, OX = ["x"], ["close"], ["high", "low", "close"], ["x", "open"]

#: Of each family, the batch queries it repeats; of each of those its output columns, with inputs and step.
FAMILIES: dict[str, Callable[[], dict[str, dict[tuple[str, ...], tuple[list[str], object]]]]] = {
    "live_observed": lambda: {
        **{
            name: {("gap",): (X, make(5)), ("full",): (C, make(9))}
            for name, make in (("sma", steps.Sma), ("math_sum", steps.Sum), ("stdev", steps.Stdev), ("variance", steps.Variance))
        },
        "variance_sample": {("v",): (X, steps.Variance(6, biased=False))},
        "volume_sma": {("volume_sma",): (["volume"], steps.Sma(20))},
        "bb": {("bb_mid", "bb_up", "bb_low"): (X, steps.Bb(10, 2.0))},
        "vwma": {("v",): (["x", "volume"], steps.Vwma(6))},
        "cmo": {("cmo",): (X, steps.Cmo(8))},
        "mfi": {("mfi",): (["x", "volume"], steps.Mfi(8))},
    },
    "live_extremes": lambda: {
        "highest_lowest": {("hi",): (X, steps.Extreme(5, 1)), ("lo",): (X, steps.Extreme(5, -1))},
        "highest_lowest_bars": {("hi",): (X, steps.ExtremeBars(5, 1)), ("lo",): (X, steps.ExtremeBars(5, -1))},
        "donchian": {("don_up", "don_mid", "don_low"): (["high", "low"], steps.Donchian(10))},
        "wpr": {("wpr",): (HLC, steps.Wpr(10))},
        "stoch": {("stoch",): (["x", "high", "low"], steps.Stoch(10))},
        "pivots": {("ph",): (X, steps.Pivot(2, 1, 1)), ("pl",): (X, steps.Pivot(2, 1, -1))},
    },
    "live_weighted": lambda: {
        "swma": {("gap",): (X, steps.Swma()), ("full",): (C, steps.Swma())},
        "wma": {("v",): (X, steps.Wma(5))},
        "alma": {("v",): (C, steps.Alma(9))},
        "hma": {("v",): (C, steps.Hma(9))},
        "linreg": {("gap",): (X, steps.Linreg(5)), ("back",): (C, steps.Linreg(8, 2))},
        "correlation": {("v",): (["close", "volume"], steps.Correlation(8))},
        "dev": {("v",): (X, steps.Dev(5))},
        "cci": {("cci",): (C, steps.Cci(7))},
        "percentile_nearest": {("v",): (X, steps.Percentile(6, 40))},
        "percentile_hazen": {("v",): (X, steps.Percentile(6, 40, linear=True))},
    },
    "live_transitions": lambda: {
        "change_mom_roc": {("change",): (X, steps.Change(1)), ("mom",): (C, steps.Change(4)), ("roc",): (X, steps.Roc(2))},
        "crosses": {("b_over",): (OX, steps.Cross(1)), ("b_under",): (OX, steps.Cross(-1)), ("b_cross",): (OX, steps.Cross())},
        "rising_falling": {("b_up",): (X, steps.Moving(2, 1)), ("b_down",): (X, steps.Moving(2, -1))},
        "barssince": {("b_since",): (["x_up"], steps.BarsSince())},
        "valuewhen": {("v",): (["up", "high"], steps.ValueWhen(1))},
    },
    "live_running": lambda: {
        "cum_obv": {("cum",): (X, steps.Cum()), ("obv",): (["close", "volume"], steps.Obv())},
        "tr": {("tr",): (HLC, steps.Tr())},
        "vwap_bands": {("vwap", "vwap_up", "vwap_low"): (["time", "x", "volume"], steps.Vwap(2.0))},
        "highest_lowest_since": {("hi",): (["new_day", "high"], steps.Since(1)), ("lo",): (["new_day", "low"], steps.Since(-1))},
    },
    "live_averages": lambda: {
        "ema": {("gap",): (X, recursive.Ema(5)), ("full",): (C, recursive.Ema(9))},
        "rma": {("v",): (X, recursive.Rma(6))},
        "rsi": {("rsi",): (X, recursive.Rsi(7))},
        "macd": {("macd", "macd_signal", "macd_hist"): (C, recursive.Macd(5, 10, 4))},
        "tsi": {("tsi",): (C, recursive.Tsi(4, 7))},
        "atr": {("atr",): (HLC, recursive.Atr(7))},
        "dmi_adx": {("plus_di", "minus_di", "adx"): (HLC, recursive.Dmi(7, 5))},
        "keltner": {("kc_up", "kc_mid", "kc_low"): ([*HLC, "close2"], recursive.Keltner(6, 1.5))},
    },
    "live_pivot_levels": lambda: {
        f"pivot_levels_{kind}": {tuple(f"lv_{n}" for n in catalogue._ORDER): (["open", *HLC, "new_day"], steps.PivotLevels(kind))} for kind in ta.LEVELS
    },
}


def _live_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bf = catalogue.hourly(spark, sf_dir)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    bf = bf.with_columns(new_day=flag(ta.new_day(bf)))
    return bf.df.select(
        "sym", "time", "open", "high", "low", "close", "volume", F.lit(True).alias("confirmed"), "x", F.col("close").alias("close2"), "new_day",
        flag(F.col("x") > F.col("open")).alias("x_up"), flag(F.col("close") > F.col("open")).alias("up"),
    )


def _columns(family: str) -> list[tuple[str, str]]:
    """(batch query, column) of a family, in the order of its steps' outputs."""
    return [(q, c) for q, parts in FAMILIES[family]().items() for names in parts for c in names]


def _run(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = lambda: {f"{q}/{names}": part for q, parts in FAMILIES[family]().items() for names, part in parts.items()}
        names = [f"{q}_{c}" for q, c in _columns(family)]
        got = replay([_live_bars(spark, sf_dir)], lambda bars: live.indicators_stream(bars, flat, names))
        wanted = [f"{q}_{c}" for q, c in _shown(family)]
        kind = lambda n: F.col(n).cast("long" if n.endswith("b_since") else "boolean") if "_b_" in n else F.round(n, 6) + 0.0
        return got.select("sym", "time", *(kind(n).alias(n) for n in wanted))

    return query


def _shown(family: str) -> list[tuple[str, str]]:
    """Without the levels that a kind doesn't define, which the batch queries leave out too."""
    return [(q, c) for q, c in _columns(family) if f" AS {c}" in catalogue.ORACLES[q]]


def _oracle(family: str) -> str:
    shown = _shown(family)
    queries = list(dict.fromkeys(q for q, _ in shown))
    joins = [f"({catalogue.ORACLES[q]}) q{k}" + (f" ON q{k}.sym = q0.sym AND q{k}.time = q0.time" if k else "") for k, q in enumerate(queries)]
    columns = ", ".join(f"q{queries.index(q)}.{c} AS {q}_{c}" for q, c in shown)
    return f"SELECT q0.sym, q0.time, {columns} FROM " + " JOIN ".join(joins)


for _family in FAMILIES:
    QUERIES[_family] = _run(_family)
    ORACLES[_family] = _oracle(_family)


# ---- requests, drawings, strategies ---------------------------------------------------------


def live_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars on a daily chart, both streamed."""
    day, week = (catalogue._orders(spark, sf_dir, every).df.select("sym", "time", "high", "close") for every in ("day", "week"))
    got = replay([day, week], lambda d, w: live.security_stream(d, w, ["close", "high"], catalogue.DAY, catalogue.WEEK), triggers=1)
    return catalogue.rounded(got, "req_close", "req_high")


QUERIES["live_security"], ORACLES["live_security"] = live_security, catalogue.ORACLES["security_fill_confirmed"]


def live_lower_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each finished week, both streamed: how many, and the sum of their closes."""
    day, week = (catalogue._orders(spark, sf_dir, every).df.select("sym", "time", "close") for every in ("day", "week"))
    got = replay([week, day], lambda w, d: live.security_lower_stream(w, d, ["close"]), triggers=1)
    total = F.aggregate("ltf_close", F.lit(0.0), lambda s, x: s + x)
    return got.select("sym", "time", F.size("ltf_close").cast("long").alias("n"), (F.round(total, 4) + 0.0).alias("sum_c"))


QUERIES["live_lower_tf"] = live_lower_tf
ORACLES["live_lower_tf"] = f"""WITH {catalogue._DAYS_SQL}, wl AS (SELECT *, lead(time) OVER (PARTITION BY sym ORDER BY time) AS e FROM weeks)
    SELECT w.sym, w.time, count(d.close) AS n, round(coalesce(sum(d.close), 0), 4) + 0.0 AS sum_c FROM wl w
    LEFT JOIN days d ON d.sym = w.sym AND d.time >= w.time AND d.time < w.e WHERE w.e IS NOT NULL GROUP BY w.sym, w.time"""


def live_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box's last state: made at midnight, its top moved five bars on, every second one deleted nine bars on."""
    bars = catalogue.hourly(spark, sf_dir).df.select("sym", "time", "high", "i")

    def build(stream: DataFrame) -> DataFrame:
        i = F.col("i")
        name = F.concat(F.lit("box"), F.floor(i / 24).cast("string"))
        rules = (
            drawing.new("box", name, i % 24 == 0, top=F.col("high")),
            drawing.set_props("box", name, i % 24 == 5, top=F.col("high")),
            drawing.delete(name, (i % 24 == 9) & (F.floor(i / 24) % 2 == 1)),
        )
        return live.drawing_stream(output.object_events(BarFrame(stream), *rules))

    touched = replay([bars], build).groupBy("sym", "id").agg(F.min("time").alias("time"), F.min("alive").alias("alive"))
    return touched.where("alive")


QUERIES["live_drawings"] = live_drawings
ORACLES["live_drawings"] = f"SELECT sym, id, time, true AS alive FROM ({catalogue.ORACLES['drawing_objects']})"


def _decide(broker: strategy.Broker, bar) -> list[dict]:
    """Long over the mean of five closes, flat under it; a second unit after a lost trade."""
    mean = broker.memory.setdefault("mean", steps.Sma(5))
    before, m = broker.memory.get("pair"), mean.push(float(bar.close))
    broker.memory["pair"] = None if m is None else (float(bar.close), m)
    if before is None or m is None:
        return []
    if before[0] <= before[1] and bar.close > m:
        return [{"type": "entry", "id": "L", "side": "long", "qty": 1.0}]
    return [{"type": "close", "id": "L"}] if before[0] >= before[1] and bar.close < m else []


def live_strategy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of ``strategy_trades``, decided bar by bar."""
    settings = strategy.Settings(initial_capital=10_000.0)
    t = strategy.trades(replay([_live_bars(spark, sf_dir)], lambda bars: live.strategy_stream(bars, _decide, settings)))
    return t.select("sym", "entry_time", "exit_time", *((F.round(c, p) + 0.0).alias(c) for c, p in (("entry_price", 6), ("exit_price", 6), ("profit", 5))))


QUERIES["live_strategy_trades"], ORACLES["live_strategy_trades"] = live_strategy_trades, catalogue.ORACLES["strategy_trades"]


def open_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots still open at the last bar."""
    bars = catalogue.hourly(spark, sf_dir).df
    last = bars.groupBy("sym").agg(F.max_by("close", "time").alias("close"))
    t = strategy.open_trades(catalogue._cross_events(spark, sf_dir), last)
    return t.select("sym", "entry_time", "qty", *((F.round(c, p) + 0.0).alias(c) for c, p in (("entry_price", 6), ("profit", 5), ("profit_percent", 5))))


QUERIES["strategy_open_trades"] = open_trades
ORACLES["strategy_open_trades"] = f"""WITH {catalogue._CROSS}, l AS (SELECT sym, last(close ORDER BY time) AS c, last(held ORDER BY time) AS held, max(CASE WHEN turn = 1 THEN time END) AS entry_time FROM f GROUP BY sym)
    SELECT l.sym, l.entry_time, 1.0 AS qty, round(f.close, 6) + 0.0 AS entry_price, round(l.c - f.close, 5) + 0.0 AS profit, round(100 * (l.c - f.close) / f.close, 5) + 0.0 AS profit_percent
    FROM l JOIN f ON f.sym = l.sym AND f.time = l.entry_time WHERE l.held = 1"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the crossing strategy asks of an account that holds two of symbols with an even number of letters."""
    bf = ta.sma(catalogue.hourly(spark, sf_dir), "close", 5, "m")
    account = bf.df.select("sym").distinct().withColumn("position", F.when(F.length("sym") % 2 == 0, 2.0).otherwise(0.0))
    entry = {"type": "entry", "id": "L", "side": "long", "qty": 1.0, "when": F.col("close") > F.col("m")}
    leave = {"type": "close", "id": "L", "qty_percent": 25.0, "when": F.col("close") < F.col("m")}
    return strategy.intents(bf, account, entry, leave).select("sym", "time", "type", "side", "qty")


QUERIES["strategy_intents"] = intents
ORACLES["strategy_intents"] = f"""WITH {catalogue.BARS_SQL}, {catalogue._obs('close', 5, catalogue.AVG, 'm')}
    SELECT sym, time, CASE WHEN close > m THEN 'entry' ELSE 'close' END AS type, CASE WHEN close > m THEN 'long' ELSE 'short' END AS side, CASE WHEN close > m THEN 1.0 ELSE 0.5 END AS qty
    FROM m_t WHERE close > m OR (close < m AND length(sym) % 2 = 0)"""
