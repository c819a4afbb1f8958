"""Registered queries over the reference tables, each with the SQL that must give the same rows.

All run on bars by symbol. ``close`` has gaps in the column ``x``: every seventh bar is
missing, so that each operator's rule for missing values shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as coll
from ..functions import scalar as sc
from ..functions import times
from ..operators import align, context, output, recursive, strategy, ta
from ..operators.frame import BarFrame, fixnan, nz, switch
from ..sources.bars import from_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Hourly bars of events by type, with gaps in x.
BARS_SQL = """
raw AS (SELECT event_type AS sym, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events WHERE value IS NOT NULL GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY time) - 1 AS i,
        CASE WHEN (row_number() OVER (PARTITION BY sym ORDER BY time) - 1) % 7 <> 3 THEN close END AS x FROM raw)
"""


def hourly(spark: SparkSession, sf_dir: str) -> BarFrame:
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    bf = BarFrame(from_ticks(ticks, "event_type", "ts", "value", "hour", "event_id")).together()
    bf = bf.with_columns(i=bf.index())
    return bf.with_columns(x=F.when(F.col("i") % 7 != 3, F.col("close")))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """sym, time and the named columns; doubles rounded, since sums in another order differ in the last bits."""
    kinds = dict(df.dtypes)
    value = lambda n: (F.round(n, places) + 0.0).alias(n) if kinds[n] == "double" else F.col(n)
    return df.select("sym", "time", *(value(n) for n in names))


def _rounded_sql(columns: dict[str, str], source: str, places: int = 6) -> str:
    cols = ", ".join(f"round({e}, {places}) + 0.0 AS {n}" if not n.startswith("b_") else f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT sym, time, {cols} FROM {source}"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _bars(name: str, build: Callable[[BarFrame], BarFrame], columns: dict[str, str], extra: str = "", source: str = "bars") -> None:
    """A query on the hourly bars: its columns, and the SQL of each. ``extra``: further CTEs. Names with ``b_`` aren't rounded."""
    sql = f"WITH {BARS_SQL}{', ' + extra if extra else ''} " + _rounded_sql(columns, source)
    register(name, sql)(lambda spark, sf_dir: rounded(build(hourly(spark, sf_dir)).df, *columns))


def _w(n: int | None = None, part: str = "sym", end: str = "CURRENT ROW") -> str:
    frame = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    return f"OVER (PARTITION BY {part} ORDER BY time ROWS BETWEEN {frame} AND {end})"


def _obs(x: str, n: int, agg: str, name: str = "v", source: str = "bars") -> str:
    """CTEs ``<name>_o`` and ``<name>``: ``source`` with ``name``, the aggregate of x's last n observations."""
    return f"""{name}_o AS (SELECT *, {x} AS {name}_x FROM {source}),
{name}_p AS (SELECT *, CASE WHEN {name}_x IS NOT NULL AND count({name}_x) {_w(n, f'sym, ({name}_x IS NOT NULL)')} = {n} THEN {agg.format(x=name + '_x', w=_w(n, f'sym, ({name}_x IS NOT NULL)'))} END AS {name}_r FROM {name}_o),
{name}_t AS (SELECT *, last_value({name}_r IGNORE NULLS) {_w()} AS {name} FROM {name}_p)"""


SUM, AVG, STD = "sum({x}) {w}", "avg({x}) {w}", "stddev_pop({x}) {w}"

# ---- bars -----------------------------------------------------------------------------------


@register("bars_hourly", f"WITH {BARS_SQL} SELECT sym, time, open, high, low, close, volume FROM bars")
def bars_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).df.select("sym", "time", "open", "high", "low", "close", "volume")


def _ticks(table: str, sym: str, ts: str, value: str, tie: list[str], every: str, volume: str | None = None):
    return lambda spark, sf_dir: from_ticks(spark.read.parquet(f"{sf_dir}/{table}.parquet"), sym, ts, value, every, tie, volume).select("sym", "time", "open", "high", "low", "close", (F.round("volume", 4) + 0.0).alias("volume"))


for _every in ("day", "week", "month"):
    register(f"bars_orders_{_every}", f"""SELECT o_orderpriority AS sym, CAST(epoch(date_trunc('{_every}', o_orderdate)) AS BIGINT) AS time,
        first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL""")(_ticks("orders", "o_orderpriority", "o_orderdate", "o_totalprice", ["o_orderkey"], _every))  # fmt: skip
register("bars_lineitem_day", """SELECT l_returnflag AS sym, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS time,
        first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, round(CAST(sum(l_quantity) AS DOUBLE), 4) + 0.0 AS volume
        FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL""")(_ticks("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", ["l_orderkey", "l_linenumber"], "day", "l_quantity"))  # fmt: skip


@register(
    "sma_cross_signals",
    f"""WITH {BARS_SQL}, {_obs('close', 5, AVG, 'm')},
    p AS (SELECT *, lag(close) OVER (PARTITION BY sym, (close IS NOT NULL AND m IS NOT NULL) ORDER BY time) AS c0, lag(m) OVER (PARTITION BY sym, (close IS NOT NULL AND m IS NOT NULL) ORDER BY time) AS m0 FROM m_t)
    SELECT sym, time, close, CASE WHEN close > m THEN 'buy' ELSE 'sell' END AS signal FROM p WHERE (c0 <= m0 AND close > m) OR (c0 >= m0 AND close < m)""",
)
def sma_cross_signals(spark, sf_dir):
    bf = ta.sma(hourly(spark, sf_dir), "close", 5, "m")
    bf = ta.crossunder(ta.crossover(bf, "close", "m", "up"), "close", "m", "down")
    return bf.df.where("up OR down").select("sym", "time", "close", F.when(F.col("up"), "buy").otherwise("sell").alias("signal"))


_bars("sources", lambda b: b.sources(), {"hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4", "hlcc4": "(high + low + close + close) / 4"})
_bars("bar_state", lambda b: (lambda s: s.with_columns(b_index=F.col("bar_index"), b_last=F.col("last_bar_index"), b_first=F.col("isfirst"), b_end=F.col("islast")))(b.bar_state()),
      {"b_index": "i", "b_last": "count(*) OVER (PARTITION BY sym) - 1", "b_first": "i = 0", "b_end": "i = count(*) OVER (PARTITION BY sym) - 1"})
_bars("time_close", lambda b: b.time_closes().with_columns(b_close=F.col("time_close")), {"b_close": "coalesce(nxt, time + least_step)"},
      f"s AS (SELECT *, lead(time) OVER (PARTITION BY sym ORDER BY time) AS nxt FROM bars), s2 AS (SELECT *, min(nxt - time) OVER (PARTITION BY sym) AS least_step FROM s)", "s2")
_bars("history_ref", lambda b: b.history("x", 3, "x3").history("close", 1, "c1"), {"x3": "lag(x, 3) OVER (PARTITION BY sym ORDER BY time)", "c1": "lag(close) OVER (PARTITION BY sym ORDER BY time)"})
_bars(
    "nz_fixnan",
    lambda b: fixnan(b, "x", "filled").with_columns(zero=nz(F.col("x")), minus=nz(F.col("x"), -1.0)),
    {"filled": f"last_value(x IGNORE NULLS) {_w()}", "zero": "coalesce(x, 0)", "minus": "coalesce(x, -1)"},
)
_bars(
    "when_switch",
    lambda b: b.with_columns(pick=switch((F.col("x") > F.col("open"), F.lit(1.0)), (F.col("x") < F.col("open"), F.lit(-1.0)), default=0.0)),
    {"pick": "CASE WHEN x > open THEN 1.0 WHEN x < open THEN -1.0 ELSE 0.0 END"},
)

# ---- observation windows -------------------------------------------------------------------

for _name, _f, _agg in (("sma", ta.sma, AVG), ("math_sum", ta.rolling_sum, SUM), ("stdev", ta.stdev, STD), ("variance", ta.variance, "var_pop({x}) {w}")):
    _bars(_name, lambda b, f=_f: f(f(b, "x", 5, "gap"), "close", 9, "full"), {"gap": "a", "full": "c"}, _obs("x", 5, _agg, "a") + ", " + _obs("close", 9, _agg, "c", "a_t"), "c_t")
_bars("variance_sample", lambda b: ta.variance(b, "x", 6, "v", biased=False), {"v": "v"}, _obs("x", 6, "var_samp({x}) {w}"), "v_t")
_bars("volume_sma", lambda b: ta.volume_sma(b, 20), {"volume_sma": "v"}, _obs("volume", 20, AVG), "v_t")
_bars("bb", lambda b: ta.bb(b, "x", 10, 2.0), {"bb_mid": "m", "bb_up": "m + 2 * s", "bb_low": "m - 2 * s"}, _obs("x", 10, AVG, "m") + ", " + _obs("x", 10, STD, "s", "m_t"), "s_t")
_bars("vwma", lambda b: ta.vwma(b, "x", 6, "v"), {"v": "CASE WHEN q > 0 THEN p / q END"}, _obs("x * volume", 6, SUM, "p") + ", " + _obs("volume", 6, SUM, "q", "p_t"), "q_t")
_LAG = "lag({}, {}) OVER (PARTITION BY sym ORDER BY time)"
_DELTA = "d AS (SELECT *, x - lag(x) OVER (PARTITION BY sym ORDER BY time) AS dx FROM bars)"
_bars("cmo", lambda b: ta.cmo(b, "x", 8), {"cmo": "CASE WHEN i >= 8 AND u + w <> 0 THEN 100 * (u - w) / (u + w) END"},
      _DELTA + ", " + _obs("CASE WHEN dx >= 0 THEN dx ELSE 0 END", 8, SUM, "u", "d") + ", " + _obs("CASE WHEN dx >= 0 THEN 0 ELSE -dx END", 8, SUM, "w", "u_t"), "w_t")
_bars("mfi", lambda b: ta.mfi(b, "x", 8), {"mfi": "CASE WHEN w IS NULL OR w = 0 THEN 100 ELSE 100 - 100 / (1 + u / w) END"},
      _DELTA + ", " + _obs("CASE WHEN dx > 0 THEN x * volume ELSE 0 END", 8, SUM, "u", "d") + ", " + _obs("CASE WHEN dx < 0 THEN x * volume ELSE 0 END", 8, SUM, "w", "u_t"), "w_t")

# ---- extremes --------------------------------------------------------------------------------

_SEG = f"g AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) {_w()} AS seg FROM bars)"
_bars("highest_lowest", lambda b: ta.lowest(ta.highest(b, "x", 5, "hi"), "x", 5, "lo"),
      {"hi": f"CASE WHEN x IS NOT NULL AND i >= 4 THEN max(x) {_w(5, 'sym, seg')} END", "lo": f"CASE WHEN x IS NOT NULL AND i >= 4 THEN min(x) {_w(5, 'sym, seg')} END"}, _SEG, "g")
_bars("highest_lowest_bars", lambda b: ta.lowestbars(ta.highestbars(b, "x", 5, "hi"), "x", 5, "lo"),
      {"hi": f"CASE WHEN i >= 4 THEN CASE WHEN x IS NULL THEN 0.0 ELSE CAST(k - i AS DOUBLE) END END", "lo": "CASE WHEN i >= 4 THEN CASE WHEN x IS NULL THEN 0.0 ELSE CAST(k2 - i AS DOUBLE) END END"},
      _SEG + f""", g2 AS (SELECT *, max(x) {_w(5, 'sym, seg')} AS mx, min(x) {_w(5, 'sym, seg')} AS mn FROM g),
      g3 AS (SELECT a.*, (SELECT min(b.i) FROM g b WHERE b.sym = a.sym AND b.seg = a.seg AND b.i BETWEEN a.i - 4 AND a.i AND b.x = a.mx) AS k,
             (SELECT min(b.i) FROM g b WHERE b.sym = a.sym AND b.seg = a.seg AND b.i BETWEEN a.i - 4 AND a.i AND b.x = a.mn) AS k2 FROM g2 a)""", "g3")  # fmt: skip
_HL = f"h AS (SELECT *, CASE WHEN i >= 9 THEN max(high) {_w(10)} END AS hh, CASE WHEN i >= 9 THEN min(low) {_w(10)} END AS ll FROM bars)"
_bars("donchian", lambda b: ta.donchian(b, 10), {"don_up": "hh", "don_mid": "(hh + ll) / 2", "don_low": "ll"}, _HL, "h")
_bars("wpr", lambda b: ta.wpr(b, 10), {"wpr": "CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END"}, _HL, "h")
_bars("stoch", lambda b: ta.stoch(b, "x", 10), {"stoch": f"last_value(r IGNORE NULLS) {_w()}"}, _HL + ", r AS (SELECT *, CASE WHEN hh <> ll THEN 100 * (x - ll) / (hh - ll) END AS r FROM h)", "r")

# ---- weighted and full windows ---------------------------------------------------------------


def _dot(x: str, weights: list[float], w: str = "OVER (PARTITION BY sym ORDER BY time)") -> str:
    return " + ".join(f"{c!r} * {f'lag({x}, {k}) {w}' if k else x}" for k, c in enumerate(weights))


_bars("swma", lambda b: ta.swma(ta.swma(b, "x", "gap"), "close", "full"), {"gap": f"({_dot('x', [1, 2, 2, 1])}) / 6.0", "full": f"({_dot('close', [1, 2, 2, 1])}) / 6.0"})
_bars("wma", lambda b: ta.wma(b, "x", 5, "v"), {"v": f"CASE WHEN x IS NOT NULL AND seen >= 5 THEN ({_dot('f', [5, 4, 3, 2, 1])}) / 15.0 END"},
      f"f AS (SELECT *, last_value(x IGNORE NULLS) {_w()} AS f, count(x) {_w()} AS seen FROM bars)", "f")


def _alma_weights(n: int) -> list[float]:
    import math

    raw = [math.exp(-((i - 0.85 * (n - 1)) ** 2) / (2 * (n / 6.0) ** 2)) for i in range(n)]
    return [w / sum(raw) for w in reversed(raw)]


_bars("alma", lambda b: ta.alma(b, "close", 9, "v"), {"v": _dot("close", _alma_weights(9))})
_bars("hma", lambda b: ta.hma(b, "close", 9, "v"), {"v": f"CASE WHEN i >= 10 THEN ({_dot('q', [3, 2, 1])}) / 6.0 END"},
      f"q AS (SELECT *, 2 * ({_dot('close', [4, 3, 2, 1])}) / 10.0 - ({_dot('close', [9, 8, 7, 6, 5, 4, 3, 2, 1])}) / 45.0 AS q FROM bars)", "q")
_bars(
    "linreg",
    lambda b: ta.linreg(ta.linreg(b, "x", 5, "gap"), "close", 8, "back", 2),
    {
        "gap": f"CASE WHEN count(x) {_w(5)} = 5 THEN regr_intercept(x, i) {_w(5)} + regr_slope(x, i) {_w(5)} * i END",
        "back": f"CASE WHEN i >= 7 THEN regr_intercept(close, i) {_w(8)} + regr_slope(close, i) {_w(8)} * (i - 2) END",
    },
)
_bars("correlation", lambda b: ta.correlation(b, "close", "volume", 8, "v"),
      {"v": f"CASE WHEN i >= 7 THEN CASE WHEN var_pop(close) {_w(8)} = 0 OR max(volume) {_w(8)} = min(volume) {_w(8)} THEN 0 ELSE corr(close, volume) {_w(8)} END END"})
_LIST = "l AS (SELECT *, list({x}) {w} AS ls, avg({x}) {w} AS mean, count({x}) {w} AS n FROM bars)"
_bars("dev", lambda b: ta.dev(b, "x", 5, "v"), {"v": "CASE WHEN n = 5 THEN list_sum(list_transform(ls, lambda e: abs(e - mean))) / 5 END"}, _LIST.format(x="x", w=_w(5)), "l")
_bars(
    "cci",
    lambda b: ta.cci(b, "close", 7),
    {
        "cci": "CASE WHEN n = 7 THEN CASE WHEN max(close) OVER (PARTITION BY sym ORDER BY time ROWS 6 PRECEDING) = min(close) OVER (PARTITION BY sym ORDER BY time ROWS 6 PRECEDING) THEN 0 ELSE (close - mean) / (0.015 * list_sum(list_transform(ls, lambda e: abs(e - mean))) / 7) END END",
    },
    _LIST.format(x="close", w=_w(7)),
    "l",
)
_bars("percentile_nearest", lambda b: ta.percentile_nearest_rank(b, "x", 6, 40, "v"), {"v": "CASE WHEN n = 6 THEN list_sort(ls)[3] END"}, _LIST.format(x="x", w=_w(6)), "l")
_bars(
    "percentile_hazen",
    lambda b: ta.percentile_linear_interpolation(b, "x", 6, 40, "v"),
    {"v": "CASE WHEN n = 6 THEN list_sort(ls)[2] + 0.9 * (list_sort(ls)[3] - list_sort(ls)[2]) END"},
    _LIST.format(x="x", w=_w(6)),
    "l",
)

# ---- lags, transitions, anchors ----------------------------------------------------------------

_bars(
    "change_mom_roc",
    lambda b: ta.roc(ta.mom(ta.change(b, "x", 1), "close", 4, "mom"), "x", 2),
    {
        "change": "x - " + _LAG.format("x", 1),
        "mom": "close - " + _LAG.format("close", 4),
        "roc": f"100 * (x - {_LAG.format('x', 2)}) / nullif({_LAG.format('x', 2)}, 0)",
    },
)
_PAIR = "p AS (SELECT *, lag(x) OVER (PARTITION BY sym, (x IS NOT NULL) ORDER BY time) AS x0, lag(open) OVER (PARTITION BY sym, (x IS NOT NULL) ORDER BY time) AS o0 FROM bars)"
_bars(
    "crosses",
    lambda b: ta.cross(ta.crossunder(ta.crossover(b, "x", "open", "b_over"), "x", "open", "b_under"), "x", "open", "b_cross"),
    {
        "b_over": "coalesce(x IS NOT NULL AND x0 <= o0 AND x > open, false)",
        "b_under": "coalesce(x IS NOT NULL AND x0 >= o0 AND x < open, false)",
        "b_cross": "coalesce(x IS NOT NULL AND ((x0 < o0 AND x > open) OR (x0 > o0 AND x < open)), false)",
    },
    _PAIR,
    "p",
)
_bars(
    "rising_falling",
    lambda b: ta.falling(ta.rising(b, "x", 2, "b_up"), "x", 2, "b_down"),
    {
        "b_up": f"coalesce(last_value(u IGNORE NULLS) {_w()}, false)",
        "b_down": f"coalesce(last_value(d IGNORE NULLS) {_w()}, false)",
    },
    _PAIR + ", q AS (SELECT *, lag(x0) OVER (PARTITION BY sym, (x IS NOT NULL) ORDER BY time) AS x1 FROM p), q2 AS (SELECT *, CASE WHEN x IS NOT NULL THEN coalesce(x > x0 AND x0 > x1, false) END AS u, CASE WHEN x IS NOT NULL THEN coalesce(x < x0 AND x0 < x1, false) END AS d FROM q)",
    "q2",
)
_bars("barssince", lambda b: ta.barssince(b, F.col("x") > F.col("open"), "b_since"), {"b_since": f"i - last_value(CASE WHEN x > open THEN i END IGNORE NULLS) {_w()}"})
_bars("valuewhen", lambda b: ta.valuewhen(b, F.col("close") > F.col("open"), "high", 1, "v"), {"v": f"last_value(hv IGNORE NULLS) {_w()}"},
      "c AS (SELECT *, close > open AS hit FROM bars), c2 AS (SELECT *, CASE WHEN hit THEN lag(high) OVER (PARTITION BY sym, hit ORDER BY time) END AS hv FROM c)", "c2")
_PIV = _SEG + """, pv AS (SELECT *, max(x) OVER (PARTITION BY sym, seg, (x IS NULL) ORDER BY time ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lh, max(x) OVER (PARTITION BY sym, seg, (x IS NULL) ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS rh,
    min(x) OVER (PARTITION BY sym, seg, (x IS NULL) ORDER BY time ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ll, min(x) OVER (PARTITION BY sym, seg, (x IS NULL) ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS rl FROM g)"""
_bars(
    "pivots",
    lambda b: ta.pivotlow(ta.pivothigh(b, "x", 2, 1, "ph"), "x", 2, 1, "pl"),
    {
        "ph": "lag(CASE WHEN i >= 2 AND coalesce(x >= lh, true) AND coalesce(x > rh, true) THEN x END) OVER (PARTITION BY sym ORDER BY time)",
        "pl": "lag(CASE WHEN i >= 2 AND coalesce(x <= ll, true) AND coalesce(x < rl, true) THEN x END) OVER (PARTITION BY sym ORDER BY time)",
    },
    _PIV,
    "pv",
)
_bars("cum_obv", lambda b: ta.obv(ta.cum(b, "x", "cum")), {"cum": f"CASE WHEN x IS NOT NULL THEN sum(x) {_w()} END", "obv": f"CASE WHEN i > 0 THEN sum(f) {_w()} END"},
      "o AS (SELECT *, sign(close - lag(close) OVER (PARTITION BY sym ORDER BY time)) * volume AS f FROM bars)", "o")
_bars(
    "tr",
    lambda b: ta.tr(b),
    {"tr": "CASE WHEN c0 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c0), abs(low - c0)) END"},
    "t AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY time) AS c0 FROM bars)",
    "t",
)
_DAY = f"""a AS (SELECT *, (time // 86400) IS DISTINCT FROM lag(time // 86400) OVER (PARTITION BY sym ORDER BY time) AS nd FROM bars),
    a2 AS (SELECT *, sum(CASE WHEN nd THEN 1 ELSE 0 END) {_w()} AS grp FROM a)"""
_VW = {"p": "x * volume", "q": "CASE WHEN x IS NOT NULL THEN volume END", "r": "x * x * volume"}
_bars(
    "vwap_bands",
    lambda b: ta.vwap(b, "x", mult=2.0, out=("vwap", "vwap_up", "vwap_low")),
    {"vwap": "m", "vwap_up": "m + 2 * sqrt(greatest(s2 - m * m, 0))", "vwap_low": "m - 2 * sqrt(greatest(s2 - m * m, 0))"},
    _DAY + f", a3 AS (SELECT *, CASE WHEN x IS NOT NULL THEN sum(x * volume) {_w(None, 'sym, grp')} / sum(CASE WHEN x IS NOT NULL THEN volume END) {_w(None, 'sym, grp')} END AS m, sum(x * x * volume) {_w(None, 'sym, grp')} / sum(CASE WHEN x IS NOT NULL THEN volume END) {_w(None, 'sym, grp')} AS s2 FROM a2)",
    "a3",
)
_bars(
    "highest_lowest_since",
    lambda b: ta.lowest_since(ta.highest_since(b, ta_day(b), "hi"), ta_day(b), "lo"),
    {"hi": f"max(high) {_w(None, 'sym, grp')}", "lo": f"min(low) {_w(None, 'sym, grp')}"},
    _DAY,
    "a2",
)
_bars("timeframe_change", lambda b: b.with_columns(b_day=ta_day(b)), {"b_day": "nd"}, _DAY, "a2")


def ta_day(b: BarFrame) -> Column:
    return ta.new_day(b)


_PERIOD = _DAY + f""", pp AS (SELECT sym, grp, first(open ORDER BY time) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY time) AS c FROM a2 GROUP BY sym, grp),
    pq AS (SELECT a2.sym, a2.time, pp.o AS o, pp.h AS h, pp.l AS l, pp.c AS c, pp.h - pp.l AS r, pp.h / nullif(pp.l, 0) AS q, first_value(a2.open) OVER (PARTITION BY a2.sym, a2.grp ORDER BY a2.time) AS n,
           CASE WHEN pp.c = pp.o THEN pp.h + pp.l + 2 * pp.c WHEN pp.c > pp.o THEN 2 * pp.h + pp.l + pp.c ELSE 2 * pp.l + pp.h + pp.c END AS x
           FROM a2 LEFT JOIN pp ON a2.sym = pp.sym AND a2.grp = pp.grp + 1)"""
for _kind, _levels in ta.LEVELS.items():
    _names = ("p", "r1", "s1", "r2", "s2", "r3", "s3", "r4", "s4", "r5", "s5")
    _sql = {f"lv_{n}": (f"({e})" if k else e) for k, (n, e) in enumerate(zip(_names, _levels, strict=True)) if e}
    _bars(
        f"pivot_levels_{_kind}",
        lambda b, kind=_kind, names=tuple(_sql): (lambda f: f.with_columns(**{n: F.get("lv", F.lit(_ORDER.index(n[3:]))) for n in names}))(ta.pivot_point_levels(b, kind, ta_day(b), "lv")),
        _sql,
        _PERIOD + f", pr AS (SELECT *, {_levels[0]} AS p FROM pq)",
        "pr",
    )
_ORDER = ("p", "r1", "s1", "r2", "s2", "r3", "s3", "r4", "s4", "r5", "s5")

# ---- averages with memory ---------------------------------------------------------------------


def _avg(name: str, x: str, n: int, alpha: float, source: str = "bars", repeat: bool = False) -> str:
    """CTE ``<name>_t``: ``source`` with ``name``, the average of x begun with the mean of its first n values."""
    return f"""{name}_s AS MATERIALIZED (SELECT *, {x} AS {name}_x FROM {source}),
{name}_r AS (SELECT sym, i, CASE WHEN {name}_x IS NULL THEN 0 ELSE 1 END AS cnt, coalesce({name}_x, 0.0) AS tot, CASE WHEN {n} = 1 THEN {name}_x END AS v FROM {name}_s WHERE i = 0
  UNION ALL SELECT s.sym, s.i, r.cnt + CASE WHEN s.{name}_x IS NOT NULL AND r.cnt < {n} THEN 1 ELSE 0 END, r.tot + CASE WHEN s.{name}_x IS NOT NULL AND r.cnt < {n} THEN s.{name}_x ELSE 0 END,
  CASE WHEN s.{name}_x IS NULL THEN r.v WHEN r.cnt < {n - 1} THEN NULL WHEN r.cnt = {n - 1} THEN (r.tot + s.{name}_x) / {n} ELSE {alpha!r} * s.{name}_x + {1 - alpha!r} * r.v END
  FROM {name}_r r JOIN {name}_s s ON s.sym = r.sym AND s.i = r.i + 1),
{name}_t AS (SELECT s.*, {'r.v' if repeat else f'CASE WHEN s.{name}_x IS NOT NULL THEN r.v END'} AS {name} FROM {name}_s s JOIN {name}_r r ON s.sym = r.sym AND s.i = r.i)"""


def _chain(name: str, build: Callable[[BarFrame], BarFrame], columns: dict[str, str], extra: str, source: str) -> None:
    _bars(name, build, columns, extra, source)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


_chain("ema", lambda b: recursive.ema(recursive.ema(b, "x", 5, "gap"), "close", 9, "full"), {"gap": "a", "full": "c"}, _avg("a", "x", 5, 2 / 6) + ", " + _avg("c", "close", 9, 2 / 10, "a_t"), "c_t")
_chain("rma", lambda b: recursive.rma(b, "x", 6, "v"), {"v": "a"}, _avg("a", "x", 6, 1 / 6), "a_t")
_chain(
    "rsi",
    lambda b: recursive.rsi(b, "x", 7),
    {"rsi": "CASE WHEN dx IS NOT NULL AND i >= 7 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END"},
    _DELTA + ", " + _avg("g", "CASE WHEN dx > 0 THEN dx WHEN dx <= 0 THEN 0 END", 7, 1 / 7, "d") + ", " + _avg("l", "CASE WHEN dx < 0 THEN -dx WHEN dx >= 0 THEN 0 END", 7, 1 / 7, "g_t"),
    "l_t",
)
_chain("macd", lambda b: recursive.macd(b, "close", 5, 10, 4), {"macd": "f - s", "macd_signal": "m", "macd_hist": "f - s - m"},
       ", ".join((_avg("f", "close", 5, 2 / 6), _avg("s", "close", 10, 2 / 11, "f_t"), _avg("m", "f - s", 4, 2 / 5, "s_t"))), "m_t")
_chain(
    "tsi",
    lambda b: recursive.tsi(b, "close", 4, 7),
    {"tsi": "CASE WHEN q <> 0 THEN p / q END"},
    "d AS (SELECT *, close - lag(close) OVER (PARTITION BY sym ORDER BY time) AS dc FROM bars), " + ", ".join((_avg("a", "dc", 7, 2 / 8, "d"), _avg("p", "a", 4, 2 / 5, "a_t"), _avg("c", "abs(dc)", 7, 2 / 8, "p_t"), _avg("q", "c", 4, 2 / 5, "c_t"))),
    "q_t",
)
_TR = "t AS (SELECT *, CASE WHEN lag(close) OVER (PARTITION BY sym ORDER BY time) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (PARTITION BY sym ORDER BY time)), abs(low - lag(close) OVER (PARTITION BY sym ORDER BY time))) END AS tr FROM bars)"
_chain("atr", lambda b: recursive.atr(b, 7), {"atr": "a"}, _TR + ", " + _avg("a", "tr", 7, 1 / 7, "t", True), "a_t")
_MOVES = """m AS (SELECT *, CASE WHEN i > 0 THEN tr END AS str, high - lag(high) OVER (PARTITION BY sym ORDER BY time) AS up, lag(low) OVER (PARTITION BY sym ORDER BY time) - low AS dn FROM t)"""
_chain("dmi_adx", lambda b: recursive.dmi(b, 7, 5), {"plus_di": "pd", "minus_di": "md", "adx": "100 * z"},
       ", ".join((_TR, _MOVES, _avg("r", "str", 7, 1 / 7, "m", True), _avg("p", "CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END", 7, 1 / 7, "r_t", True),
                  _avg("n", "CASE WHEN dn IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END", 7, 1 / 7, "p_t", True),
                  f"di AS (SELECT *, last_value(100 * p / nullif(r, 0) IGNORE NULLS) {_w()} AS pd, last_value(100 * n / nullif(r, 0) IGNORE NULLS) {_w()} AS md FROM n_t)",
                  _avg("z", "abs(pd - md) / CASE WHEN pd + md = 0 THEN 1 ELSE pd + md END", 5, 1 / 5, "di", True))), "z_t")
_chain("keltner", lambda b: recursive.keltner(b, 6, 1.5), {"kc_up": "m + 1.5 * w", "kc_mid": "m", "kc_low": "m - 1.5 * w"},
       ", ".join((_TR, _avg("m", "close", 6, 2 / 7, "t"), _avg("w", "CASE WHEN i > 0 THEN tr END", 6, 2 / 7, "m_t"))), "w_t")
_chain("keltner_atr", lambda b: recursive.keltner(b, 6, 2.0, width="atr"), {"kc_up": "m + 2 * w", "kc_mid": "m", "kc_low": "m - 2 * w"},
       ", ".join((_TR, _avg("m", "close", 6, 2 / 7, "t"), _avg("w", "tr", 6, 1 / 6, "m_t", True))), "w_t")


def _dynamic(name: str, x: str, alpha: str, source: str) -> str:
    """The average whose length ``len`` is a column."""
    return f"""{name}_s AS MATERIALIZED (SELECT *, {x} AS {name}_x, CAST(3 + i % 4 AS DOUBLE) AS len FROM {source}),
{name}_r AS (SELECT sym, i, {name}_x AS v FROM {name}_s WHERE i = 0
  UNION ALL SELECT s.sym, s.i, CASE WHEN s.{name}_x IS NULL THEN r.v WHEN r.v IS NULL THEN s.{name}_x ELSE {alpha} * s.{name}_x + (1 - {alpha}) * r.v END FROM {name}_r r JOIN {name}_s s ON s.sym = r.sym AND s.i = r.i + 1),
{name}_t AS (SELECT s.* EXCLUDE (len), r.v AS {name} FROM {name}_s s JOIN {name}_r r ON s.sym = r.sym AND s.i = r.i)"""


def _length() -> Column:
    return F.col("i") % 4 + 3


_chain("ema2_rma2_atr2", lambda b: recursive.atr2(recursive.rma2(recursive.ema2(b, "x", _length(), "e2"), "x", _length(), "r2"), _length(), "a2"), {"e2": "e", "r2": "r", "a2": "a"},
       ", ".join((_TR, _dynamic("e", "x", "2 / (s.len + 1)", "t"), _dynamic("r", "x", "(1 / s.len)", "e_t"), _dynamic("a", "tr", "(1 / s.len)", "r_t"))), "a_t")
# state machines, bar by bar in recursive SQL
_BEFORE = "OVER (PARTITION BY sym ORDER BY time)"
_chain(
    "sar",
    recursive.sar,
    {"sar": "sar"},
    f"""b AS MATERIALIZED (SELECT *, lag(high) {_BEFORE} AS h1, lag(low) {_BEFORE} AS l1, lag(high, 2) {_BEFORE} AS h2, lag(low, 2) {_BEFORE} AS l2, lag(close) {_BEFORE} AS c1 FROM bars),
    r AS (SELECT sym, time, i, CAST(NULL AS DOUBLE) AS sar, 0.0::DOUBLE AS best, 0.02::DOUBLE AS speed, false AS up FROM b WHERE i = 0
      UNION ALL SELECT sym, time, i,
        CASE WHEN i = 1 THEN CASE WHEN close > c1 THEN l1 ELSE h1 END
             WHEN up <> turn THEN least(CASE WHEN turn THEN least(low, best) ELSE s END, l1, l2) ELSE greatest(CASE WHEN turn THEN greatest(high, best) ELSE s END, h1, h2) END,
        CASE WHEN i = 1 THEN CASE WHEN close > c1 THEN high ELSE low END WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(best, high) ELSE least(best, low) END,
        CASE WHEN i = 1 OR turn THEN 0.02 WHEN up AND high > best OR NOT up AND low < best THEN least(speed + 0.02, 0.2) ELSE speed END,
        CASE WHEN i = 1 THEN close > c1 ELSE up <> turn END
      FROM (SELECT *, i > 1 AND ((up AND s > low) OR (NOT up AND s < high)) AS turn FROM (SELECT b.*, r.best, r.speed, r.up, r.sar + r.speed * (r.best - r.sar) AS s FROM r JOIN b ON b.sym = r.sym AND b.i = r.i + 1)))""",
    "r",
)
_chain(
    "supertrend",
    lambda b: recursive.supertrend(b, 2.0, 7),
    {"supertrend": "line", "trend": "dir"},
    f"""{_TR}, {_avg('a', 'tr', 7, 1 / 7, 't', True)}, b AS MATERIALIZED (SELECT *, (high + low) / 2 - 2 * a AS rl, (high + low) / 2 + 2 * a AS ru, lag(close) {_BEFORE} AS c1, lag(a) {_BEFORE} AS a1 FROM a_t),
    r AS (SELECT sym, time, i, rl AS lower, ru AS upper, 0.0::DOUBLE AS line, 1.0::DOUBLE AS dir FROM b WHERE i = 0
      UNION ALL SELECT sym, time, i, lower, upper, CASE WHEN lower IS NOT NULL AND upper IS NOT NULL THEN CASE WHEN dir < 0 THEN lower ELSE upper END END, dir
      FROM (SELECT *, CASE WHEN a1 IS NULL THEN 1.0 WHEN line = u0 THEN CASE WHEN close > upper THEN -1.0 ELSE 1.0 END WHEN close < lower THEN 1.0 ELSE -1.0 END AS dir
        FROM (SELECT *, CASE WHEN rl > l0 OR c1 < l0 THEN rl WHEN rl IS NOT NULL THEN l0 END AS lower, CASE WHEN ru < u0 OR c1 > u0 THEN ru WHEN ru IS NOT NULL THEN u0 END AS upper
          FROM (SELECT b.*, r.line, coalesce(r.lower, 0.0) AS l0, coalesce(r.upper, 0.0) AS u0 FROM r JOIN b ON b.sym = r.sym AND b.i = r.i + 1))))""",
    "r",
)


def _place(k: int) -> str:
    """SQL: the value at place k (from 0) of a window of sorted values ``v`` with missing places ``g``, each with ``b`` values before it."""
    gap = f"len(list_filter(g, lambda x, m: x.b + m - 1 = {k})) > 0"
    return f"CASE WHEN i >= 5 AND NOT ({gap}) THEN v[{k + 1} - len(list_filter(g, lambda x, m: x.b + m - 1 < {k}))] END"


_chain(
    "percentile_through_gaps",
    lambda b: recursive.percentile_through_gaps(recursive.percentile_through_gaps(b, "x", 6, 40, "near"), "x", 6, 40, "linear", linear=True),
    {"near": "p2", "linear": "p1 + 0.9 * (p2 - p1)"},
    f"""b AS MATERIALIZED (SELECT *, lag(x, 6) {_BEFORE} AS old FROM bars),
    r AS (SELECT sym, time, i, CASE WHEN x IS NULL THEN [] ELSE [x] END AS v, CASE WHEN x IS NULL THEN [{{'b': 0, 'n': i}}] ELSE [] END AS g FROM b WHERE i = 0
      UNION ALL SELECT sym, time, i, CASE WHEN x IS NULL THEN v ELSE v[1:j] || [x] || v[j + 1:] END,
        CASE WHEN x IS NULL THEN g || [{{'b': len(v), 'n': i}}] ELSE list_transform(g, lambda p: {{'b': CASE WHEN p.b >= CASE WHEN x <= old THEN j ELSE j + 1 END THEN p.b + 1 ELSE p.b END, 'n': p.n}}) END
      FROM (SELECT *, len(list_filter(v, lambda e: e < x)) AS j FROM (SELECT sym, time, i, x, old,
          CASE WHEN old IS NULL THEN v ELSE v[1:k - 1] || v[k + 1:] END AS v,
          CASE WHEN old IS NULL THEN list_filter(g, lambda p: p.n > i - 6) ELSE list_transform(g, lambda p: {{'b': CASE WHEN p.b >= k THEN p.b - 1 ELSE p.b END, 'n': p.n}}) END AS g
        FROM (SELECT b.*, r.v, r.g, len(list_filter(r.v, lambda e: e <= b.old)) AS k FROM r JOIN b ON b.sym = r.sym AND b.i = r.i + 1)))),
    q AS (SELECT *, {_place(2)} AS p2, {_place(1)} AS p1 FROM r)""",
    "q",
)

# ---- alignment ------------------------------------------------------------------------------------

_DAYS_SQL = """
days AS (SELECT o_orderpriority AS sym, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS time, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL),
weeks AS (SELECT o_orderpriority AS sym, CAST(epoch(date_trunc('week', o_orderdate)) AS BIGINT) AS time, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
          last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL)"""
DAY, WEEK = 86_400, 7 * 86_400


def _orders(spark: SparkSession, sf_dir: str, every: str) -> BarFrame:
    return BarFrame(from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", every, "o_orderkey"))


def _security(gaps: bool, lookahead: bool):
    delay = 0 if lookahead else WEEK - DAY
    match = f"LEFT JOIN weeks w ON w.sym = d.sym AND w.time + {delay} = d.time" if gaps else f"ASOF LEFT JOIN (SELECT *, time + {delay} AS seen FROM weeks) w ON w.sym = d.sym AND d.time >= w.seen"
    name = f"security_{'gaps' if gaps else 'fill'}_{'lookahead' if lookahead else 'confirmed'}"

    @register(name, f"WITH {_DAYS_SQL} SELECT d.sym, d.time, round(w.close, 6) + 0.0 AS req_close, round(w.high, 6) + 0.0 AS req_high FROM days d {match}")
    def query(spark, sf_dir):
        return rounded(align.security(_orders(spark, sf_dir, "day"), _orders(spark, sf_dir, "week"), ["close", "high"], DAY, WEEK, gaps, lookahead).df, "req_close", "req_high")


for _gaps in (False, True):
    for _look in (False, True):
        _security(_gaps, _look)


@register(
    "security_history_sma",
    f"""WITH {_DAYS_SQL}, h AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY time) AS p, CASE WHEN row_number() OVER (PARTITION BY sym ORDER BY time) >= 3 THEN avg(close) OVER (PARTITION BY sym ORDER BY time ROWS 2 PRECEDING) END AS m, time + {WEEK - DAY} AS seen FROM weeks)
    SELECT d.sym, d.time, round(w.p, 6) + 0.0 AS req_p, round(w.m, 6) + 0.0 AS req_m FROM days d ASOF LEFT JOIN h w ON w.sym = d.sym AND d.time >= w.seen""",
)
def security_history_sma(spark, sf_dir):
    weeks = ta.sma(_orders(spark, sf_dir, "week").history("close", 1, "p"), "close", 3, "m")
    return rounded(align.security(_orders(spark, sf_dir, "day"), weeks, ["p", "m"], DAY, WEEK).df, "req_p", "req_m")


_OWN = """, wl AS (SELECT *, coalesce(lead(time) OVER (PARTITION BY sym ORDER BY time), time + 604800) AS e FROM weeks),
    own AS (SELECT w.sym, w.time, d.time AS t, d.open AS o, d.close AS c, d.volume AS v FROM wl w JOIN days d ON d.sym = w.sym AND d.time >= w.time AND d.time < w.e)"""


@register(
    "lower_tf_groups",
    f"WITH {_DAYS_SQL} {_OWN} SELECT w.sym, w.time, count(o.c) AS n, round(first(o.c ORDER BY o.t), 6) + 0.0 AS first_c, round(last(o.c ORDER BY o.t), 6) + 0.0 AS last_c, round(sum(o.c), 4) + 0.0 AS sum_c, round(min(o.c), 6) + 0.0 AS min_c, round(max(o.c), 6) + 0.0 AS max_c, round(avg(o.c), 4) + 0.0 AS avg_c FROM weeks w LEFT JOIN own o ON o.sym = w.sym AND o.time = w.time GROUP BY w.sym, w.time",
)
def lower_tf_groups(spark, sf_dir):
    g = F.col("ltf_close")
    df = align.security_lower_tf(_orders(spark, sf_dir, "week"), _orders(spark, sf_dir, "day"), ["close"], WEEK).df
    six, four = (lambda c: F.round(c, 6) + 0.0), (lambda c: F.round(c, 4) + 0.0)
    return df.select("sym", "time", align.group_size(g).cast("long").alias("n"), six(align.group_first(g)).alias("first_c"), six(align.group_last(g)).alias("last_c"), four(align.group_sum(g)).alias("sum_c"), six(align.group_min(g)).alias("min_c"), six(align.group_max(g)).alias("max_c"), four(align.group_avg(g)).alias("avg_c"))


_SIGN = """, ds AS (SELECT *, v * CASE WHEN c <> o THEN sign(c - o) ELSE coalesce(sign(c - pc), 0) END AS sv FROM (SELECT own.*, pv.pc FROM own JOIN (SELECT sym, time AS t, lag(close) OVER (PARTITION BY sym ORDER BY time) AS pc FROM days) pv ON pv.sym = own.sym AND pv.t = own.t))"""


@register(
    "up_down_volume",
    f"WITH {_DAYS_SQL} {_OWN} {_SIGN} SELECT w.sym, w.time, coalesce(sum(CASE WHEN sv > 0 THEN sv END), 0.0) + 0.0 AS up_volume, coalesce(sum(CASE WHEN sv < 0 THEN sv END), 0.0) + 0.0 AS down_volume, coalesce(sum(sv), 0.0) + 0.0 AS volume_delta FROM weeks w LEFT JOIN ds ON ds.sym = w.sym AND ds.time = w.time GROUP BY w.sym, w.time",
)
def up_down_volume(spark, sf_dir):
    return rounded(align.up_down_volume(_orders(spark, sf_dir, "week"), _orders(spark, sf_dir, "day"), WEEK).df, "up_volume", "down_volume", "volume_delta")


@register(
    "cumulative_volume_delta",
    f"""WITH {_DAYS_SQL} {_OWN} {_SIGN}, run AS (SELECT *, sum(sv) OVER (PARTITION BY sym, time ORDER BY t) AS s FROM ds),
    wk AS (SELECT w.sym, w.time, greatest(coalesce(max(s), 0.0), 0.0) AS h, least(coalesce(min(s), 0.0), 0.0) AS l, coalesce(last(s ORDER BY t), 0.0) AS s FROM weeks w LEFT JOIN run ON run.sym = w.sym AND run.time = w.time GROUP BY w.sym, w.time),
    g AS (SELECT *, sum(CASE WHEN time % 2419200 < 604800 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY time) AS grp FROM wk),
    b AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY sym, grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b FROM g)
    SELECT sym, time, b + 0.0 AS cvd_open, b + h AS cvd_high, b + l AS cvd_low, b + s AS cvd_close FROM b""",
)
def cumulative_volume_delta(spark, sf_dir):
    got = align.volume_delta(_orders(spark, sf_dir, "week"), _orders(spark, sf_dir, "day"), WEEK, F.col("time") % (4 * WEEK) < WEEK)
    return rounded(got.df, "cvd_open", "cvd_high", "cvd_low", "cvd_close")


# ---- scalar functions ------------------------------------------------------------------------------

_bars(
    "math_functions",
    lambda b: b.with_columns(
          lg=sc.m_log(F.col("close") - 5), sq=sc.m_sqrt(F.col("close") - 5), ce=sc.m_ceil(F.col("x")), fl=sc.m_floor(F.col("x")), tr=sc.m_trunc(F.col("x") - F.col("open")), mx=sc.m_max(F.col("x"), F.col("open")),
          mn=sc.m_min(F.col("x"), F.col("open")), av=sc.m_avg(F.col("high"), F.col("low"), F.col("close")), sg=sc.m_sign(F.col("close") - F.col("open")), tick=sc.round_to_mintick(F.col("close"), 0.25), ex=sc.m_exp(-F.col("volume")), pw=sc.m_pow(F.col("volume"), 2.0)),
    {
        "lg": "CASE WHEN close > 5 THEN ln(close - 5) END",
        "sq": "CASE WHEN close >= 5 THEN sqrt(close - 5) END",
        "ce": "ceil(x)",
        "fl": "floor(x)",
        "tr": "trunc(x - open)",
        "mx": "CASE WHEN x IS NOT NULL THEN greatest(x, open) END",
        "mn": "CASE WHEN x IS NOT NULL THEN least(x, open) END",
        "av": "(high + low + close) / 3",
        "sg": "sign(close - open)",
        "tick": "floor(close / 0.25 + 0.5) * 0.25",
        "ex": "exp(-volume)",
        "pw": "pow(volume, 2)",
    },
)


@register(
    "string_functions",
    """SELECT o_orderkey, length(p) AS n, substring(p, 3, 4) AS part, instr(p, '-') - 1 AS pos, contains(p, 'URG') AS has, starts_with(p, '1') AS pre, suffix(p, 'H') AS suf,
    upper(p) AS up, lower(p) AS low, replace(p, '-', '+') AS repl, regexp_replace(p, '-', '/') AS once, trim(p) AS tr, repeat(o_orderstatus, 2) AS twice, len(string_split(p, '-')) AS parts,
    CASE WHEN regexp_matches(p, '[A-Z]+') THEN regexp_extract(p, '[A-Z]+') END AS hit, concat(o_orderstatus, ':', p) AS form, TRY_CAST(substring(p, 1, 1) AS DOUBLE) AS num FROM (SELECT *, o_orderpriority AS p FROM orders)""",
)
def string_functions(spark, sf_dir):
    p = F.col("o_orderpriority")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", sc.s_length(p).cast("long").alias("n"), sc.s_substring(p, 2, 6).alias("part"), sc.s_pos(p, "-").cast("long").alias("pos"), sc.s_contains(p, "URG").alias("has"), sc.s_startswith(p, "1").alias("pre"), sc.s_endswith(p, "H").alias("suf"),
        sc.s_upper(p).alias("up"), sc.s_lower(p).alias("low"), sc.s_replace_all(p, "-", "+").alias("repl"), sc.s_replace(p, "-", "/").alias("once"), sc.s_trim(p).alias("tr"), sc.s_repeat(F.col("o_orderstatus"), 2).alias("twice"),
        F.size(sc.s_split(p, "-")).cast("long").alias("parts"), sc.s_match(p, "[A-Z]+").alias("hit"), sc.s_format("{}:{}", F.col("o_orderstatus"), p).alias("form"), sc.tonumber(sc.s_substring(p, 0, 1)).alias("num"),
    )


_L = "(to_timestamp(time) AT TIME ZONE 'UTC')"
_bars(
    "time_parts",
    lambda b: b.with_columns(**{f"b_{n}": f(F.col("time")).cast("long") for n, f in (("y", times.year), ("mo", times.month), ("d", times.dayofmonth), ("w", times.dayofweek), ("h", times.hour), ("mi", times.minute), ("s", times.second))},
                                             b_day=times.bar_open(F.col("time"), "1D"), b_week=times.bar_open(F.col("time"), "1W"), b_month=times.bar_open(F.col("time"), "1M"), b_4h=times.bar_open(F.col("time"), "240")),
    {
        "b_y": f"year({_L})",
        "b_mo": f"month({_L})",
        "b_d": f"day({_L})",
        "b_w": f"dayofweek({_L}) + 1",
        "b_h": f"hour({_L})",
        "b_mi": f"minute({_L})",
        "b_s": f"CAST(second({_L}) AS BIGINT)",
        "b_day": "time // 86400 * 86400",
        "b_week": "CAST(epoch(date_trunc('week', " + _L + ")) AS BIGINT)",
        "b_month": "CAST(epoch(date_trunc('month', " + _L + ")) AS BIGINT)",
        "b_4h": "time // 14400 * 14400",
    },
)
_bars(
    "session_filter",
    lambda b: b.with_columns(b_day=times.in_session(F.col("time"), "0930-1600:23456"), b_night=times.in_session(F.col("time"), "2200-0500:2345")),
    {
        "b_day": f"(hour({_L}) * 60 BETWEEN 570 AND 959) AND dayofweek({_L}) BETWEEN 1 AND 5",
        "b_night": f"(hour({_L}) >= 22 AND dayofweek({_L}) + 1 IN (1, 2, 3, 4)) OR (hour({_L}) < 5 AND dayofweek({_L}) + 1 IN (2, 3, 4, 5))",
    },
)
_bars(
    "timeframe_change_week",
    lambda b: times.timeframe_change(b, "1W", "b_week"),
    {
        "b_week": f"coalesce(date_trunc('week', {_L}) <> lag(date_trunc('week', {_L})) OVER (PARTITION BY sym ORDER BY time), true)",
    },
)
_bars(
    "color_functions",
    lambda b: b.with_columns(b_mix=sc.from_gradient(F.col("close"), F.col("low"), F.col("high"), "#000000", "#ff8040"), b_up=sc.color_when(F.col("close") > F.col("open"), "#00ff00", "#ff0000"), b_red=sc.red(sc.rgb(F.lit(17), F.lit(34), F.lit(51)))),
    {
        "b_mix": "'#' || printf('%02x%02x%02x', CAST(floor(255 * s) AS INT), CAST(floor(128 * s) AS INT), CAST(floor(64 * s) AS INT))",
        "b_up": "CASE WHEN close > open THEN '#00ff00' ELSE '#ff0000' END",
        "b_red": "17.0::DOUBLE",
    },
    "c AS (SELECT *, greatest(0, least(1, (close - low) / (high - low + 1e-10))) AS s FROM bars)",
    "c",
)
_ARR = "l AS (SELECT *, list(close) OVER (PARTITION BY sym ORDER BY time ROWS 3 PRECEDING) AS a FROM bars)"


def _with_array(b: BarFrame) -> BarFrame:
    return b.with_columns(a=F.collect_list("close").over(b.last_rows(4)))


_bars(
    "array_functions",
    lambda b: (lambda g, a: g.with_columns(b_n=coll.size(a).cast("long"), f=coll.first(a), la=coll.last(a), su=coll.total(a), av=coll.avg(a), mi=coll.least(a), ma=coll.greatest(a), top=coll.first(coll.sort(a, descending=True)), b_at=coll.indexof(a, F.col("close")).cast("long"),
                                                                   pushed=coll.last(coll.push(a, F.lit(1.0))), b_rest=coll.size(coll.shift(a)).cast("long"), b_has=coll.includes(a, F.col("open")), cut=coll.total(coll.cut(a, 0, 2)), b_order=F.array_join(coll.sort_indices(a), ",")))(_with_array(b), F.col("a")),
    {
        "b_n": "len(a)",
        "f": "a[1]",
        "la": "a[-1]",
        "su": "list_sum(a)",
        "av": "list_avg(a)",
        "mi": "list_min(a)",
        "ma": "list_max(a)",
        "top": "list_reverse_sort(a)[1]",
        "b_at": "list_position(a, close) - 1",
        "pushed": "1.0",
        "b_rest": "len(a) - 1",
        "b_has": "list_contains(a, open)",
        "cut": "list_sum(a[1:2])",
        "b_order": "array_to_string(list_transform(list_grade_up(a), lambda e: e - 1), ',')",
    },
    _ARR,
    "l",
)


def _maps(b: BarFrame) -> BarFrame:
    m = F.create_map(F.lit("o"), F.col("open"), F.lit("c"), F.col("close"))
    put = coll.map_put(m, F.lit("h"), F.col("high"))
    both = coll.map_put_all(m, F.create_map(F.lit("c"), F.col("low"), F.lit("v"), F.col("volume")))
    return b.with_columns(got=coll.map_get(put, F.lit("h")), none=coll.map_get(m, F.lit("z"), F.lit(-1.0)), b_n=coll.map_size(both).cast("long"), c=coll.map_get(both, F.lit("c")), b_has=coll.map_contains(coll.map_remove(m, F.lit("o")), F.lit("o")), b_keys=F.array_join(coll.map_keys(put), ","))


_bars("map_functions", _maps, {"got": "high", "none": "-1.0", "b_n": "3::BIGINT", "c": "low", "b_has": "false", "b_keys": "'o,c,h'"})


def _matrices(b: BarFrame) -> BarFrame:
    b = b.with_columns(m=coll.matrix_from_rows(F.array("open", "high"), F.array("low", "close")))
    m = F.col("m")
    b = b.with_columns(product=coll.matrix_mult(m, coll.transpose(m)))
    cells = {f"p{i}{j}": coll.matrix_get(F.col("product"), *at) for i, j, at in ((0, 0, (0, 0)), (0, 1, (0, 1)), (1, 1, (-1, -1)))}
    return b.with_columns(
        **cells, total=coll.matrix_sum(m), avg=coll.matrix_avg(coll.matrix_add(m, 1.0)), big=coll.matrix_max(m),
        col=coll.total(coll.matrix_col(m, 1)), row=coll.total(coll.matrix_row(m, 1)),
    )


_bars(
    "matrix_functions",
    _matrices,
    {
        "p00": "open * open + high * high",
        "p01": "open * low + high * close",
        "p11": "low * low + close * close",
        "total": "open + high + low + close",
        "avg": "(open + high + low + close) / 4 + 1",
        "big": "greatest(open, high, low, close)",
        "col": "high + close",
        "row": "low + close",
    },
)

# ---- strategy ------------------------------------------------------------------------------------------


def _cross_events(spark: SparkSession, sf_dir: str, settings: strategy.Settings = strategy.Settings(initial_capital=10_000.0)) -> DataFrame:
    bf = ta.sma(hourly(spark, sf_dir), "close", 5, "m")
    bf = ta.crossunder(ta.crossover(bf, "close", "m", "up"), "close", "m", "down")
    rules = ({"type": "entry", "id": "L", "side": "long", "qty": 1.0, "when": F.col("up")}, {"type": "close", "id": "L", "when": F.col("down")})
    return strategy.simulate(strategy.with_commands(bf, *rules), settings=settings)


_CROSS = f"""{BARS_SQL}, {_obs('close', 5, AVG, 'm')},
    p AS (SELECT *, lag(close) OVER (PARTITION BY sym, (m IS NOT NULL) ORDER BY time) AS c0, lag(m) OVER (PARTITION BY sym, (m IS NOT NULL) ORDER BY time) AS m0 FROM m_t),
    s AS (SELECT *, CASE WHEN c0 <= m0 AND close > m THEN 1 WHEN c0 >= m0 AND close < m THEN 0 END AS sg FROM p),
    h AS (SELECT *, coalesce(last_value(sg IGNORE NULLS) OVER (PARTITION BY sym ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM s),
    f AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY sym ORDER BY time), 0) AS turn FROM h)"""


@register(
    "strategy_orders",
    f"WITH {_CROSS} SELECT sym, time, CASE WHEN turn = 1 THEN 'entry' ELSE 'close' END AS type, round(close, 6) + 0.0 AS price, CAST(held AS DOUBLE) AS position_after FROM f WHERE turn <> 0",
)
def strategy_orders(spark, sf_dir):
    return strategy.orders(_cross_events(spark, sf_dir)).select("sym", "time", "type", (F.round("price", 6) + 0.0).alias("price"), "position_after")


@register(
    "strategy_trades",
    f"WITH {_CROSS}, t AS (SELECT *, lag(time) OVER (PARTITION BY sym ORDER BY time) AS entry_time, lag(close) OVER (PARTITION BY sym ORDER BY time) AS e FROM f WHERE turn <> 0) SELECT sym, entry_time, time AS exit_time, round(e, 6) + 0.0 AS entry_price, round(close, 6) + 0.0 AS exit_price, round(close - e, 5) + 0.0 AS profit FROM t WHERE turn = -1",
)
def strategy_trades(spark, sf_dir):
    t = strategy.trades(_cross_events(spark, sf_dir))
    return t.select("sym", "entry_time", "exit_time", (F.round("entry_price", 6) + 0.0).alias("entry_price"), (F.round("exit_price", 6) + 0.0).alias("exit_price"), (F.round("profit", 5) + 0.0).alias("profit"))


@register(
    "strategy_equity",
    f"WITH {_CROSS}, g AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY sym ORDER BY time), 0) * (close - lag(close) OVER (PARTITION BY sym ORDER BY time)) AS gain FROM f) SELECT sym, time, round(10000 + coalesce(sum(gain) OVER (PARTITION BY sym ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) + 0.0 AS equity, CAST(held AS DOUBLE) AS position_size FROM g",
)
def strategy_equity(spark, sf_dir):
    return strategy.equity(_cross_events(spark, sf_dir)).select("sym", "time", (F.round("equity", 4) + 0.0).alias("equity"), "position_size")


def strategy_brackets(spark, sf_dir):
    """Entries at a limit, reversed by stops, with costs, brackets, a position cap and risk rules: the lifecycle."""
    bf = ta.sma(hourly(spark, sf_dir), "close", 8, "m")
    rules = (
        {"type": "entry", "id": "L", "side": "long", "qty": 3.0, "limit": F.col("m") * 0.9, "when": F.col("i") % 6 == 0}, {"type": "entry", "id": "S", "side": "short", "qty": 1.0, "stop": F.col("m") * 0.7, "when": F.col("i") % 9 == 0},
        {"type": "exit", "id": "X", "from_entry": "L", "qty_percent": 50.0, "stop": F.col("m") * 0.6, "limit": F.col("m") * 1.4}, {"type": "cancel", "id": "S", "when": F.col("i") % 5 == 0},
    )
    settings = strategy.Settings(initial_capital=10_000.0, pyramiding=1, slippage=1, commission_type="percent", commission_value=0.1, max_position_size=5.0, max_intraday_loss=5.0, verify_limits=1)
    return strategy.lifecycle(strategy.simulate(strategy.with_commands(bf, *rules), settings=settings))


QUERIES["strategy_brackets"] = strategy_brackets


@register(
    "strategy_summary",
    f"""WITH {_CROSS}, tr AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY time) AS e FROM f WHERE turn <> 0),
    done AS (SELECT sym, coalesce(sum(close - e) FILTER (turn = -1 AND close >= e), 0) AS won, coalesce(sum(close - e) FILTER (turn = -1 AND close < e), 0) AS lost,
          count(*) FILTER (turn = -1) AS closed_trades, count(*) FILTER (turn = -1 AND close > e) AS winning_trades, last(close ORDER BY time) AS entry FROM tr GROUP BY sym),
    l AS (SELECT sym, last(close ORDER BY time) AS c, CAST(last(held ORDER BY time) AS DOUBLE) AS held FROM f GROUP BY sym),
    sums AS (SELECT l.sym, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost, held * coalesce(c - entry, 0) AS op, held, coalesce(closed_trades, 0) AS closed_trades, coalesce(winning_trades, 0) AS winning_trades FROM l LEFT JOIN done ON done.sym = l.sym)
    SELECT sym, round(10000 + won + lost + op, 4) + 0.0 AS equity, round(won + lost, 4) + 0.0 AS net_profit, round(op, 4) + 0.0 AS open_profit, round(won, 4) + 0.0 AS gross_profit, round(lost, 4) + 0.0 AS gross_loss,
        0.0 AS commission, held AS position_size, false AS locked, closed_trades, winning_trades FROM sums""",
)
def strategy_summary(spark, sf_dir):
    money = ("equity", "net_profit", "open_profit", "gross_profit", "gross_loss", "commission")
    return strategy.summary(_cross_events(spark, sf_dir)).withColumns({c: F.round(c, 4) + 0.0 for c in money})


# ---- outputs ----------------------------------------------------------------------------------------------


@register(
    "plot_series",
    f"WITH {BARS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY time DESC) AS k FROM bars) SELECT sym, time, 'gap' AS name, 'line' AS kind, round(x, 6) + 0.0 AS value, CASE WHEN close > open THEN 'green' ELSE 'red' END AS color FROM r WHERE k <= 100",
)
def plot_series(spark, sf_dir):
    bf = hourly(spark, sf_dir)
    df = output.plot(bf, "x", "gap", sc.color_when(F.col("close") > F.col("open"), "green", "red"), show_last=100)
    return df.withColumn("value", F.round("value", 6) + 0.0)


@register("markers", f"WITH {BARS_SQL} SELECT sym, time, 'up' AS name, 'triangleup' AS shape, 'belowbar' AS location, 'U' AS text, CAST(NULL AS VARCHAR) AS color FROM bars WHERE x > open")
def markers(spark, sf_dir):
    return output.markers(hourly(spark, sf_dir), F.col("x") > F.col("open"), "up", "triangleup", "belowbar", "U")


@register(
    "signals",
    f"WITH {BARS_SQL} SELECT sym, time, 'gap' AS name, '' AS message FROM bars WHERE x IS NULL UNION ALL SELECT sym, time, 'wide' AS name, '' AS message FROM bars WHERE high > 2 * low",
)
def signals(spark, sf_dir):
    return output.alert_conditions(hourly(spark, sf_dir), gap=F.col("x").isNull(), wide=F.col("high") > 2 * F.col("low"))


@register("report_frame", f"WITH {BARS_SQL} SELECT sym, time, close AS a, high AS b FROM bars")
def report_frame(spark, sf_dir):
    bf = hourly(spark, sf_dir)
    return output.Report().add(lines=output.plot(bf, "close", "a")).add(lines=output.plot(bf, "high", "b")).to_frame(["a", "b"])


@register("drawing_objects", f"""WITH {BARS_SQL}, e AS (SELECT sym, 'box' || CAST(i // 24 AS VARCHAR) AS id, i, time, high FROM bars WHERE i % 24 IN (0, 5, 9)),
    l AS (SELECT sym, id, min(time) AS time, last(high ORDER BY i) AS top FROM e WHERE i % 24 IN (0, 5) GROUP BY sym, id), d AS (SELECT DISTINCT sym, id FROM e WHERE i % 24 = 9 AND (i // 24) % 2 = 1)
    SELECT l.sym, l.id, l.time, round(l.top, 6) + 0.0 AS top FROM l ANTI JOIN d ON l.sym = d.sym AND l.id = d.id""")  # fmt: skip
def drawing_objects(spark, sf_dir):
    bf = hourly(spark, sf_dir)
    name, i = F.concat(F.lit("box"), F.floor(F.col("i") / 24).cast("string")), F.col("i")
    log = output.object_events(bf, {"op": "new", "kind": "box", "id": name, "when": i % 24 == 0, "props": {"top": F.col("high")}}, {"op": "set", "id": name, "when": i % 24 == 5, "props": {"top": F.col("high")}}, {"op": "delete", "id": name, "when": (i % 24 == 9) & (F.floor(i / 24) % 2 == 1)})
    return output.objects(log).select("sym", "id", "time", (F.round(F.col("props")["top"].cast("double"), 6) + 0.0).alias("top"))


# ---- surroundings -----------------------------------------------------------------------------------------

_SYMBOLS = {"view": "WEB:VIEW", "click": {"ticker": "CLICK", "mintick": 0.25}, "error": None}


@register("symbol_facts", f"""WITH {BARS_SQL} SELECT sym, time, CASE sym WHEN 'view' THEN 'WEB:VIEW' WHEN 'click' THEN 'CLICK' ELSE '' END AS tickerid,
    CASE sym WHEN 'view' THEN 'WEB' ELSE '' END AS prefix, CASE sym WHEN 'click' THEN 0.25 ELSE 1.0 END AS mintick FROM bars""")  # fmt: skip
def symbol_facts(spark, sf_dir):
    facts = ("tickerid", "prefix", "mintick")
    return context.with_symbols(hourly(spark, sf_dir), context.symbols(spark, _SYMBOLS), *facts).df.select("sym", "time", *facts)


@register("session_state", f"WITH {BARS_SQL} SELECT sym, time, true AS ismarket, i = 0 AS isfirstbar, i = count(*) OVER (PARTITION BY sym) - 1 AS islastbar FROM bars")
def session_state(spark, sf_dir):
    return context.session_state(hourly(spark, sf_dir)).df.select("sym", "time", "ismarket", "isfirstbar", "islastbar")


@register(
    "request_report",
    f"""WITH {_DAYS_SQL}, w AS (SELECT sym, count(*) AS n, min(time) + {WEEK - DAY} AS seen, max(time) + {WEEK} AS through FROM weeks GROUP BY sym)
    SELECT d.sym, count(*) AS chart_bars, any_value(w.n) AS requested_bars, count(*) FILTER (d.time < w.seen) AS without, any_value(w.through) AS through FROM days d JOIN w ON w.sym = d.sym GROUP BY d.sym""",
)
def request_report(spark, sf_dir):
    return context.request_report(_orders(spark, sf_dir, "day"), _orders(spark, sf_dir, "week"), DAY, WEEK)
