"""Sources, admission, frames, windows with gaps, alignment, outputs and streams, against plain loops and worked cases."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from barframe.functions import collections as coll
from barframe.functions import scalar as sc
from barframe.functions import times
from barframe.operators import align, output, recursive, ta
from barframe.operators.frame import BarFrame, fixnan, modulo, ne, switch, truthy
from barframe.sources import bars as src


def frame(spark, xs, syms=("a", "b")):
    """Bars whose x is ``xs`` (None: missing), alike for each symbol but shuffled on input."""
    rows = [(s, 60 * i, float(i), x if x is None else float(x), x if x is None else float(x) + 1, x if x is None else float(x) - 1, float(1 + i % 3)) for s in syms for i, x in enumerate(xs)]
    random.Random(0).shuffle(rows)
    return BarFrame(spark.createDataFrame(rows, "sym string, time long, n double, x double, high double, low double, volume double"))


def values(bf, name, sym="a"):
    return [r[0] for r in bf.df.where(F.col("sym") == sym).orderBy("time").select(name).collect()]


def close_to(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-9, abs=1e-9)), (i, g, w)


MASKED = [None if random.Random(i).random() < 0.22 else random.Random(i + 99).randint(1, 9) for i in range(80)]


def last_obs(xs, n, f):
    out, seen, last = [], [], None
    for x in xs:
        if x is not None:
            seen.append(x)
            last = f(seen[-n:]) if len(seen) >= n else None
        out.append(last)
    return out


@pytest.mark.parametrize("n", [1, 3, 7, 200])
def test_observation_windows(spark, n):
    bf = frame(spark, MASKED)
    mean = lambda w: sum(w) / len(w)
    close_to(values(ta.sma(bf, "x", n, "o"), "o"), last_obs(MASKED, n, mean))
    close_to(values(ta.rolling_sum(bf, "x", n, "o"), "o"), last_obs(MASKED, n, sum))
    close_to(values(ta.stdev(bf, "x", n, "o"), "o", "b"), last_obs(MASKED, n, lambda w: math.sqrt(sum((x - mean(w)) ** 2 for x in w) / n)))


@pytest.mark.parametrize("n", [1, 4])
def test_extremes_restart_after_gaps(spark, n):
    def loop(high):
        out = []
        for i, x in enumerate(MASKED):
            run = []
            for k in range(i, max(i - n, -1), -1):
                if MASKED[k] is None:
                    break
                run.append(MASKED[k])
            out.append(None if x is None or i < n - 1 else (max if high else min)(run))
        return out

    bf = frame(spark, MASKED)
    close_to(values(ta.highest(bf, "x", n, "o"), "o"), loop(True))
    close_to(values(ta.lowest(bf, "x", n, "o"), "o"), loop(False))


def test_pairs_pivots_and_runs(spark):
    xs = [5, 3, 6, None, 2, 7, 7, 8, None, 9, 1, 4, 4, 2]
    bf = frame(spark, xs)
    got = values(ta.crossover(bf, "x", 5, "o"), "o")
    assert [i for i, g in enumerate(got) if g] == [2, 5]
    assert [i for i, g in enumerate(values(ta.cross(bf, "x", 5, "o"), "o")) if g] == [2, 4, 5, 10]
    assert values(ta.pivothigh(bf, "x", 1, 1, "o"), "o")[12] is None
    close_to(values(ta.pivothigh(bf, "x", 2, 1, "o"), "o"), [None, None, None, 6, None, None, None, None, 8, None, 9, None, None, 4])
    up = values(ta.rising(bf, "x", 2, "o"), "o")
    assert [i for i, g in enumerate(up) if g] == [9]
    assert values(ta.barssince(bf, F.col("x") > 6, "o"), "o") == [None] * 5 + [0, 0, 0, 1, 0, 1, 2, 3, 4]
    close_to(values(ta.valuewhen(bf, F.col("x") > 6, "x", 1, "o"), "o"), [None] * 6 + [7, 7, 7, 8, 8, 8, 8, 8])


def test_order_statistics_and_weights(spark):
    xs = [5, 3, 6, 4, 2, 7]
    bf = frame(spark, xs)
    close_to(values(ta.percentile_nearest_rank(bf, "x", 4, 50, "o"), "o"), [None] * 3 + [4, 3, 4])
    close_to(values(ta.percentile_linear_interpolation(bf, "x", 4, 50, "o"), "o"), [None] * 3 + [4.5, 3.5, 5])
    close_to(values(ta.wma(bf, "x", 3, "o"), "o")[2:4], [(5 + 6 + 18) / 6, (3 + 12 + 12) / 6])
    close_to(values(ta.linreg(bf, "x", 2, "o"), "o"), [None, 3, 6, 4, 2, 7])
    with pytest.raises(ValueError):
        ta.sma(bf, "x", 0, "o")


def test_recursive_operators_on_gaps(spark):
    bf = frame(spark, [1, None, 2, 3, None, 4])
    close_to(values(recursive.ema(bf, "x", 2, "o"), "o"), [None, None, 1.5, 2.5, None, 3.5])
    close_to(values(recursive.rma(bf, "x", 2, "o"), "o", "b"), [None, None, 1.5, 2.25, None, 3.125])
    close_to(values(recursive.ema2(bf, "x", F.lit(3.0), "o"), "o"), [1, 1, 1.5, 2.25, 2.25, 3.125])
    rsi = recursive.Rsi(2)
    assert [rsi.push(x) for x in (1.0, 2.0, 3.0, 2.0)][2:] == [100.0, pytest.approx(50.0)]
    sar = recursive.Sar(0.02, 0.02, 0.2)
    got = [sar.push(*b) for b in ((11.0, 9.0, 10.0), (13.0, 10.0, 12.0), (14.0, 12.0, 13.0), (15.0, 13.0, 14.0), (9.0, 5.0, 6.0))]
    close_to(got, [None, 9.0, 9.0, 9.2, 15.0])
    line = recursive.Supertrend(1.0, 1)
    assert [line.push(*b)[1] for b in ((11.0, 9.0, 10.0), (14.0, 13.0, 14.0), (20.0, 19.0, 20.0))][-1] == -1.0


def test_gap_percentiles():
    rng = random.Random(7)
    xs = [float(rng.randint(1, 9)) for _ in range(60)]
    near, linear = recursive.GapPercentile(5, 40, False), recursive.GapPercentile(5, 40, True)
    for i, x in enumerate(xs):
        w = sorted(xs[max(i - 4, 0) : i + 1])
        assert near.push(x) == (w[1] if i >= 4 else None) and linear.push(x) == (pytest.approx(w[1] + (w[2] - w[1]) * 0.5) if i >= 4 else None)
    gap = recursive.GapPercentile(3, 50, False)
    assert [gap.push(x) for x in (1.0, None, 3.0, 2.0, 5.0)] == [None, None, None, 2.0, 3.0]


def test_vwap_and_pivot_levels(spark):
    rows = [("a", t, 10.0 + t % 7, 15.0 + t % 5, 5.0 - t % 3, 11.0 + t % 2, 2.0) for t in range(0, 3 * 86_400, 28_800)]
    bf = BarFrame(spark.createDataFrame(rows, "sym string, time long, open double, high double, low double, close double, volume double"))
    got = values(ta.vwap(bf, "close"), "vwap")
    assert got[0] == rows[0][5] and got[3] == rows[3][5] and got[2] == pytest.approx(sum(r[5] for r in rows[:3]) / 3)
    levels = values(ta.pivot_point_levels(bf, "traditional", ta.new_day(bf), "o"), "o")
    assert levels[0] is None
    h, low, c = max(r[3] for r in rows[:3]), min(r[4] for r in rows[:3]), rows[2][5]
    assert levels[4][0] == pytest.approx((h + low + c) / 3) and levels[4][1] == pytest.approx(2 * levels[4][0] - low)


# ---- sources ------------------------------------------------------------------------------


def bar(t, o=10.0, h=12.0, low=9.0, c=11.0, v=1.0, **more):
    return {"time": t, "open": o, "high": h, "low": low, "close": c, "volume": v} | more


def test_admission_rules(spark, tmp_path):
    rows = [bar(1), bar(1), bar(2, h=8.0), bar(3, h=10.5), bar(4, low=10.5), bar(5, v=-1.0), bar(6, c=float("inf")), bar(7, o=float("nan")), bar(8)]
    good, bad = src.admit(src.from_rows(spark, rows, "s"))
    assert sorted(r.time for r in good.collect()) == [1, 8]
    assert {(r.time, r.reject) for r in bad.collect()} == {(1, "time repeats"), (2, "high is below low"), (3, "high is below open or close"), (4, "low is above open or close"), (5, "volume is negative"), (6, "close is not finite"), (7, "open is missing")}
    with pytest.raises(Exception, match="high is below low"):
        src.admit(src.from_rows(spark, rows[2:3], "s"), strict=True)[0].collect()
    assert src.admit(src.from_rows(spark, rows, "s"), allow_missing=True, unique_times=False)[0].count() == 4
    with pytest.raises(ValueError):
        src.from_rows(spark, [{"time": 1}])
    with pytest.raises(ValueError):
        src.within_budget(good, 1)
    assert src.from_rows(spark, []).count() == 0
    (tmp_path / "b.csv").write_text("t,open,high,low,close,volume,is_market\n5000,1,2,0.5,1.5,10,true\n6000,1,2,0.5,1.5,10,0\n")
    got = src.read_bars(spark, str(tmp_path / "b.csv"), "x", time_unit="ms", columns={"time": "t"}).orderBy("time").collect()
    assert [(r.sym, r.time, r.session_ismarket) for r in got] == [("x", 5, True), ("x", 6, False)]
    assert [r.time for r in src.tail(good, 1).collect()] == [8] and src.time_range(good).first()[1:] == (1, 8, 2)


def test_conditions_treat_missing_as_false(spark):
    df = spark.createDataFrame([(1.0, None), (0.0, 2.0), (float("inf"), 3.0), (-7.0, 3.0)], "a double, b double")
    got = df.select(truthy(F.col("a"), "double"), ne(F.col("a"), F.col("b")), modulo(F.col("a"), F.lit(3.0)), switch((F.col("b") > 2, F.lit("x")), default="y")).collect()
    assert [r[0] for r in got] == [True, False, False, True] and [r[1] for r in got] == [True] * 4 and got[3][2] == 2.0 and [r[3] for r in got] == ["y", "y", "x", "x"]


# ---- alignment: worked cases ------------------------------------------------------------------


def series(spark, pairs, **cols):
    return BarFrame(spark.createDataFrame([("s", t, float(v)) for t, v in pairs], "sym string, time long, close double"))


def test_security_confirms_late(spark):
    chart = series(spark, [(t, t) for t in (10, 20, 30, 40)])
    high = series(spark, [(10, 100), (30, 300)])
    at = lambda bf: {r.time: r.req_close for r in bf.df.collect()}
    assert at(align.security(chart, high, ["close"], 10, 20)) == {10: None, 20: 100, 30: 100, 40: 300}
    assert at(align.security(chart, high, ["close"], 10, 20, lookahead=True)) == {10: 100, 20: 100, 30: 300, 40: 300}
    assert at(align.security(chart, high, ["close"], 10, 20, gaps=True)) == {10: None, 20: 100, 30: None, 40: 300}
    before = high.history("close", 1, "p")
    assert {r.time: r.req_p for r in align.security(chart, before, ["p"], 10, 20).df.collect()} == {10: None, 20: None, 30: None, 40: 100}


def test_lower_timeframe_groups(spark):
    chart = series(spark, [(t, t) for t in (10, 20, 30, 40)])
    low = series(spark, [(t, t) for t in (10, 12, 18, 20, 22, 29, 31, 39, 40, 55)])
    got = {r.time: r for r in align.security_lower_tf(chart, low, ["close"], 10).df.collect()}
    assert [got[t].ltf_close for t in (10, 20, 30, 40)] == [[10, 12, 18], [20, 22, 29], [31, 39], [40]]


# ---- functions ----------------------------------------------------------------------------------


def one(spark, *cols):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_scalar_functions(spark):
    assert one(spark, sc.m_round(F.lit(2.5)), sc.m_trunc(F.lit(-1.5)), sc.m_log(F.lit(0.0)), sc.m_asin(F.lit(2.0)), sc.m_max(F.lit(1.0), F.lit(None).cast("double"))) == [2.0, -1.0, None, None, None]
    num = lambda x, f=None: sc.tostring(F.lit(x), fmt=f)
    assert one(spark, num(3.0), num(3.25), num(3.14159, "#.##"), num(3.1, "0.00"), num(0.256, "percent"), sc.tostring(F.lit(None).cast("double")), sc.tostring(F.lit(True), "boolean")) == ["3", "3.25", "3.14", "3.10", "25.6%", "na", "true"]
    assert one(spark, sc.s_replace(F.lit("a-b-c"), "-", "+", 1), sc.s_match(F.lit("abc"), "x"), sc.s_format("{1}{0}!", F.lit(1), F.lit("z")), sc.tonumber(F.lit("x"))) == ["a-b+c", None, "z1!", None]
    assert one(spark, sc.rgb(F.lit(255), F.lit(0), F.lit(16)), sc.rgb(F.lit(255), F.lit(0), F.lit(16), 25), sc.transparency(F.lit("rgba(1,2,3,0.75)")), sc.blue(F.lit("rgba(1,2,3,0.75)"))) == ["#ff0010", "rgba(255,0,16,0.75)", 25.0, 3.0]
    assert sc.ticker_modify("X:ABC?session=regular", session="extended", adjustment="splits") == "X:ABC?session=extended&adjustment=splits"
    assert sc.ticker_inherit("X:ABC", "DEF") == "X:DEF" and sc.ticker_standard("X:ABC?a=b") == "X:ABC"


def test_collections(spark):
    a = F.array(F.lit(3.0), F.lit(None), F.lit(1.0), F.lit(3.0))
    assert one(spark, coll.sort(a), coll.sort(a, True), coll.sort_indices(a), coll.indexof(a, F.lit(3.0)), coll.lastindexof(a, F.lit(3.0)), coll.includes(a, F.lit(9.0)), coll.total(a), coll.insert(a, 1, F.lit(7.0)), coll.remove(a, 0)) == [
        [1.0, 3.0, 3.0, None], [None, 3.0, 3.0, 1.0], [2, 0, 3, 1], 0, 3, False, 7.0, [3.0, 7.0, None, 1.0, 3.0], [None, 1.0, 3.0]]
    m = coll.matrix_from_rows(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(5.0), F.lit(6.0)))
    got = one(spark, coll.transpose(m), coll.matrix_mult(m, coll.transpose(m)), coll.matrix_col(m, 1), coll.reshape(m, 3, 2), coll.transpose(coll.matrix_new(0, 3)))
    assert [tuple(x) for x in (got[0], got[1])] == [(3, 2, [1.0, 4.0, 2.0, 5.0, 3.0, 6.0]), (2, 2, [14.0, 32.0, 32.0, 77.0])]
    assert got[2] == [2.0, 5.0] and got[3].rows == 3 and tuple(got[4]) == (3, 0, [])


def test_times(spark):
    t = F.lit(1_709_298_000)  # 2024-03-01 13:00 UTC, a Friday
    assert one(spark, times.dayofweek(t), times.hour(t, "America/New_York"), times.bar_open(t, "1W"), times.bar_open(t, "3M"), times.bar_open(t, "1D", "America/New_York"), times.in_session(t, "0930-1600:6"), times.in_session(t, "0800-0930", "America/New_York"), times.in_session(t, "24x7")) == [
        6, 8, 1_708_905_600, 1_704_067_200, 1_709_269_200, True, True, True]
    assert one(spark, times.timestamp(F.lit(2024), F.lit(3), F.lit(1), F.lit(8), zone="America/New_York")) == [1_709_298_000]
    assert times.Timeframe.parse("240").seconds() == 14_400 and str(times.Timeframe.from_seconds(14 * 86_400)) == "2W" and times.Timeframe.parse("M").seconds() == 30 * 86_400


# ---- outputs and streams ---------------------------------------------------------------------------


def test_report_and_objects(spark, tmp_path):
    bf = frame(spark, [1, None, 3])
    r = output.Report().add(lines=output.plot(bf, "x", "p")).add(lines=output.plot(bf, "high", "q", show_last=1))
    assert {tuple(x) for x in r.latest("p").collect()} == {("a", 3.0), ("b", 3.0)} and r.to_frame(["p", "q"]).where("q IS NOT NULL").count() == 2
    r.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 8
    with pytest.raises(KeyError):
        r.add(nonsense=bf.df)
    log = spark.createDataFrame([("a", 1, 0, "x", "new", "line", {"c": "1"}), ("a", 2, 0, "x", "set", None, {"c": "2"}), ("a", 1, 1, "y", "new", "line", {"c": "3"}), ("a", 3, 0, "y", "delete", None, {})], output.OBJECT_EVENTS)
    assert [(r.id, r.props) for r in output.objects(log).collect()] == [("x", {"c": "2"})]


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    from barframe.streaming import live

    xs = [float(random.Random(i).randint(1, 50)) for i in range(30)]
    rows = [(s, 60 * i, x, x, x, x, 1.0, True) for s in ("a", "b") for i, x in enumerate(xs)]
    os.makedirs(tmp_path / "in")
    write = lambda part, name: spark.createDataFrame(part, live.LIVE_BAR).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    write([r for r in rows if r[1] < 900], "one")

    def run():
        stream = spark.readStream.schema(live.LIVE_BAR).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = live.indicator_stream(stream, ["close"], ["ema"], lambda: recursive.Ema(5))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    run()
    # a restart: a late bar, a preview, and the rest
    write([("a", 60, 1.0, 1.0, 1.0, 1.0, 1.0, True), ("a", 900, 999.0, 999.0, 999.0, 999.0, 1.0, False), *(r for r in rows if r[1] >= 900)], "two")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    ema = recursive.Ema(5)
    want = [ema.push(x) for x in xs]
    for s in ("a", "b"):
        close_to([r.ema for r in sorted((r for r in got if r.sym == s and r.status == "confirmed"), key=lambda r: r.time)], want)
    assert [(r.sym, r.time) for r in got if r.status == "late"] == [("a", 60)] and len([r for r in got if r.status == "preview"]) == 1


def test_strategy_stream_decides_bar_by_bar(spark, tmp_path):
    from barframe.streaming import live

    rows = [("a", i, 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1.0, True) for i in range(4)]
    spark.createDataFrame(rows, live.LIVE_BAR).coalesce(1).write.parquet(str(tmp_path / "in"))

    def decide(broker, bar):
        return [{"type": "entry", "id": "L", "side": "long", "qty": 1.0}] if not broker.size and bar.time < 2 else [{"type": "close_all"}] if bar.time == 2 else []

    out = live.strategy_stream(spark.readStream.schema(live.LIVE_BAR).parquet(str(tmp_path / "in")), decide)
    out.writeStream.format("memory").queryName("events").trigger(availableNow=True).start().awaitTermination(180)
    got = spark.sql("SELECT time, price, profit FROM events WHERE kind IN ('order', 'trade') ORDER BY time, kind").collect()
    assert [(r.time, r.price, r.profit) for r in got] == [(0, 10.0, None), (2, 12.0, None), (2, 12.0, 2.0)]


def test_windows_share_one_exchange(spark, tmp_path):
    path = str(tmp_path / "bars")
    frame(spark, MASKED).df.write.parquet(path)
    bf = BarFrame(spark.read.parquet(path)).together()
    bf = ta.bb(ta.highest(ta.sma(bf, "x", 5, "m"), "x", 5, "h"), "x", 5)
    bf = fixnan(ta.crossover(bf, "x", "m", "up"), "x", "f")
    plan = bf.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = recursive.ema(recursive.rsi(BarFrame(spark.read.parquet(path)).together(), "x", 5), "x", 5, "e").df
    # one for the first step; what a step returns is dealt again for the next
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
