"""Steps against window operators, snapshots, sessions, and streams of drawings and requests."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_bars import close_to

from barframe.operators import drawing, output, recursive, steps, strategy, ta
from barframe.operators.frame import BarFrame
from barframe.streaming import live, outputs, snapshot
from barframe.streaming.replay import replay


def bars(spark, n=60, gap=0.15, seed=4):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        p = 50.0
        for i in range(n):
            p += rng.randint(-4, 4)
            x = None if rng.random() < gap else float(p)
            rows.append((s, 3600 * i, p, p + rng.randint(0, 3), p - rng.randint(0, 3), p + rng.randint(-1, 1), float(rng.randint(1, 9)), x))
    return BarFrame(spark.createDataFrame(rows, "sym string, time long, open double, high double, low double, close double, volume double, x double"))


def cond():
    return F.col("x") > F.col("open") - 1


#: Window operator, inputs, step.
PAIRS = {
    "sum": (lambda b: ta.rolling_sum(b, "x", 4, "v"), ["x"], lambda: steps.Sum(4)),
    "variance": (lambda b: ta.variance(b, "x", 4, "v", biased=False), ["x"], lambda: steps.Variance(4, biased=False)),
    "bbw": (lambda b: ta.bbw(b, "x", 4, 2.0, "v"), ["x"], lambda: steps.Bbw(4)),
    "vwma": (lambda b: ta.vwma(b, "x", 4, "v"), ["x", "volume"], lambda: steps.Vwma(4)),
    "cmo": (lambda b: ta.cmo(b, "x", 4, "v"), ["x"], lambda: steps.Cmo(4)),
    "mfi": (lambda b: ta.mfi(b, "x", 4, "v"), ["x", "volume"], lambda: steps.Mfi(4)),
    "wma": (lambda b: ta.wma(b, "x", 4, "v"), ["x"], lambda: steps.Wma(4)),
    "hma": (lambda b: ta.hma(b, "x", 9, "v"), ["x"], lambda: steps.Hma(9)),
    "alma": (lambda b: ta.alma(b, "x", 4, "v"), ["x"], lambda: steps.Alma(4)),
    "linreg": (lambda b: ta.linreg(b, "x", 4, "v", 1), ["x"], lambda: steps.Linreg(4, 1)),
    "linreg_one": (lambda b: ta.linreg(b, "x", 1, "v"), ["x"], lambda: steps.Linreg(1)),
    "correlation": (lambda b: ta.correlation(b, "x", "volume", 4, "v"), ["x", "volume"], lambda: steps.Correlation(4)),
    "dev": (lambda b: ta.dev(b, "x", 3, "v"), ["x"], lambda: steps.Dev(3)),
    "cci": (lambda b: ta.cci(b, "x", 3, "v"), ["x"], lambda: steps.Cci(3)),
    "nearest": (lambda b: ta.percentile_nearest_rank(b, "x", 4, 30, "v"), ["x"], lambda: steps.Percentile(4, 30)),
    "linear": (lambda b: ta.percentile_linear_interpolation(b, "x", 4, 30, "v"), ["x"], lambda: steps.Percentile(4, 30, linear=True)),
    "highest": (lambda b: ta.highest(b, "x", 4, "v"), ["x"], lambda: steps.Extreme(4, 1)),
    "lowestbars": (lambda b: ta.lowestbars(b, "x", 4, "v"), ["x"], lambda: steps.ExtremeBars(4, -1)),
    "highestbars": (lambda b: ta.highestbars(b, "x", 4, "v"), ["x"], lambda: steps.ExtremeBars(4, 1)),
    "wpr": (lambda b: ta.wpr(b, 4, "v", high="x"), ["x", "low", "close"], lambda: steps.Wpr(4)),
    "stoch": (lambda b: ta.stoch(b, "x", 4, "v"), ["x", "high", "low"], lambda: steps.Stoch(4)),
    "pivothigh": (lambda b: ta.pivothigh(b, "x", 2, 2, "v"), ["x"], lambda: steps.Pivot(2, 2, 1)),
    "pivotlow": (lambda b: ta.pivotlow(b, "x", 1, 0, "v"), ["x"], lambda: steps.Pivot(1, 0, -1)),
    "roc": (lambda b: ta.roc(b, "x", 2, "v"), ["x"], lambda: steps.Roc(2)),
    "over": (lambda b: ta.crossover(b, "x", 50.0, "v"), ["x", "fifty"], lambda: steps.Cross(1)),
    "under": (lambda b: ta.crossunder(b, "x", 50.0, "v"), ["x", "fifty"], lambda: steps.Cross(-1)),
    "either": (lambda b: ta.cross(b, "x", 50.0, "v"), ["x", "fifty"], lambda: steps.Cross()),
    "rising": (lambda b: ta.rising(b, "x", 2, "v"), ["x"], lambda: steps.Moving(2, 1)),
    "falling": (lambda b: ta.falling(b, "x", 1, "v"), ["x"], lambda: steps.Moving(1, -1)),
    "barssince": (lambda b: ta.barssince(b, cond(), "v"), ["cond"], lambda: steps.BarsSince()),
    "valuewhen": (lambda b: ta.valuewhen(b, cond(), "x", 1, "v"), ["cond", "x"], lambda: steps.ValueWhen(1)),
    "cum": (lambda b: ta.cum(b, "x", "v"), ["x"], lambda: steps.Cum()),
    "obv": (lambda b: ta.obv(b, "v", "x"), ["x", "volume"], lambda: steps.Obv()),
    "accdist": (lambda b: ta.accdist(b, "v"), ["high", "low", "close", "volume"], lambda: steps.Accdist()),
    "tr": (lambda b: ta.tr(b, "v", close="x", strict=True), ["high", "low", "x"], lambda: steps.Tr(strict=True)),
    "vwap": (lambda b: ta.vwap(b, "x", out="v"), ["time", "x", "volume"], lambda: steps.Vwap()),
    "vwap_anchor": (lambda b: ta.vwap(b, "x", cond(), out="v"), ["time", "x", "volume", "cond"], lambda: steps.Vwap()),
    "since": (lambda b: ta.highest_since(b, cond(), "v", "x"), ["cond", "x"], lambda: steps.Since(1)),
}


def test_steps_equal_windows(spark):
    bf = bars(spark)
    bf = bf.with_columns(cond=F.coalesce(cond(), F.lit(False)).cast("double"), fifty=F.lit(50.0))
    wanted = bf
    for name, (window, _, _) in PAIRS.items():
        got = window(bf).df.select("sym", "time", F.col("v").cast("double").alias(name))
        wanted = BarFrame(wanted.df.join(got, ["sym", "time"]))
    by_sym = {}
    for r in sorted(wanted.df.collect(), key=lambda r: (r.sym, r.time)):
        by_sym.setdefault(r.sym, []).append(r)
    for name, (_, inputs, make) in PAIRS.items():
        for rows in by_sym.values():
            step, out = make(), []
            for k, r in enumerate(rows):
                step = snapshot.decode(snapshot.encode(step)) if k % 7 == 0 else step
                v = step.push(*(r[c] for c in inputs))
                out.append(v[0] if isinstance(v, tuple) else v)
            try:
                close_to(out, [r[name] for r in rows])
            except AssertionError as e:
                raise AssertionError(name) from e


def test_sums_are_exact_after_a_level_shift():
    values = [1e16, 1.0, 1.0, 1.0, 3.0]
    mean, spread, line, total = steps.Sma(3), steps.Stdev(3), steps.Wma(3), steps.Cum()
    last = [(mean.push(x), spread.push(x), line.push(x), total.push(x)) for x in values][-1]
    assert last[0] == 5 / 3 and abs(last[1] - math.sqrt(8 / 9)) < 1e-15 and last[2] == (1 + 2 + 9) / 6 and last[3] == math.fsum(values)


def test_snapshots_refuse_what_they_do_not_know():
    text = snapshot.encode(steps.Bb(5))
    assert vars(snapshot.decode(text).mean) == vars(steps.Sma(5))
    for bad in (text.replace('"version":1', '"version":2'), text.replace("Bb", "Popen"), "[]"):
        with pytest.raises(ValueError):
            snapshot.decode(bad)
    with pytest.raises(ValueError):
        snapshot.encode(steps.Bb(5), max_bytes=10)
    with pytest.raises(TypeError):
        snapshot.encode(lambda: 1)
    odd = steps.Lag(3)
    for x in (math.inf, None, -0.0):
        odd.push(x)
    assert snapshot.decode(snapshot.encode(odd)).bars == odd.bars


def test_session_previews_and_restores():
    session = live.Session(recursive.Ema(2))
    for t, x in ((1, 1.0), (2, 3.0)):
        session.close(t, lambda s, x=x: s.push(x))
    shown = session.preview(lambda s: s.push(9.0))
    again = live.Session.restore(session.save())
    assert shown == again.preview(lambda s: s.push(9.0)) == again.close(3, lambda s: s.push(9.0))
    with pytest.raises(ValueError):
        again.close(3, lambda s: s.push(1.0))
    before = again.save()
    with pytest.raises(TypeError):
        again.close(4, lambda s: s.push("x"))
    assert again.save() == before  # a step that fails leaves no trace


def test_trades_by_number():
    broker = strategy.Broker(strategy.Settings(keep_trades=2, commission_type="cash_per_order", commission_value=1.0))
    for k in range(3):
        broker.bar(2 * k, 10.0 + k, 10.0 + k, 10.0 + k, 10.0 + k, [{"seq": 0, "type": "entry", "id": f"L{k}", "side": "long", "qty": 2.0, "comment": "in"}])
        broker.bar(2 * k + 1, 12.0, 12.0, 12.0, 12.0, [{"seq": 0, "type": "close_all", "id": "out"}])
    t = broker.closed_trades
    assert t.count == 3 and t.entry_id(0) is None and t.entry_id(1) == "L1" and t.entry_id(-1) == "L2" and t.entry_id(3) is None
    assert t.profit(1) == 2.0 and t.commission(1) == 2.0 and t.net_profit(1) == 0.0 and t.size(1) == 2.0 and t.entry_comment(1) == "in" and t.exit_id(-2) == "out"
    assert t.profit_percent(1) == 100 * 2.0 / 22.0 and t.values("entry_time") == [2, 4]
    broker.bar(9, 10.0, 10.0, 10.0, 10.0, [{"seq": 0, "type": "entry", "id": "S", "side": "short", "qty": 1.0}])
    held = broker.open_trades(8.0)
    assert held.count == 1 and held.size(0) == -1.0 and held.profit(-1) == 2.0 and held.profit_percent(0) == 20.0 and held.entry_bar(0) == 6


def test_drawings_keep_the_living():
    d = outputs.Drawings(keep_last=2)
    for t, i in enumerate("abc"):
        out = d.push(t, i, "new", "line", {"x1": str(t)})
    assert [(o["id"], o["alive"]) for o in out] == [("c", True), ("a", False)] and d.living("line") == ["b", "c"]
    assert d.push(4, "a", "set", None, {"x1": "9"}) == [] and d.push(4, "b", "set", None, {"x1": "9"})[0]["props"] == {"x1": "9"}
    assert not d.push(5, "b", "delete", None, None)[0]["alive"] and d.living() == ["c"]


def test_drawing_stream_equals_batch(spark):
    bf = bars(spark, 30, 0.0)
    i = F.col("time") / 3600
    rules = (
        drawing.new("label", F.concat(F.lit("l"), i.cast("int").cast("string")), i % 5 == 0, x=F.col("time"), y=F.col("high"), text="t"),
        drawing.set_pair("label", "l5", "xy", F.col("time"), F.col("low"), i == 12),
        drawing.new("table", "t", i == 0, position="top"),
        drawing.cell("t", 0, 1, F.col("sym"), i == 3),
        drawing.merge_cells("t", (0, 0), (1, 1), i == 4),
        drawing.delete("l10", i == 20),
    )
    want = {(r.sym, r.id): r.props for r in output.objects(output.object_events(bf, *rules)).collect()}
    got = {}
    for r in replay([bf.df], lambda s: live.drawing_stream(output.object_events(BarFrame(s), *rules))).collect():
        got.setdefault((r.sym, r.id), []).append(r)
    assert {k for k, v in got.items() if all(r.alive for r in v)} == set(want)
    # a cell or setter adds to what was there: the last state has the most properties, or the later place
    assert all(want[k] in [r.props for r in got[k]] for k in want)


def test_plots_and_markers_of_a_stream(spark):
    bf = bars(spark, 10, 0.3)
    plotted = replay([bf.df], lambda s: output.plot(BarFrame(s), "x", "p"))
    assert sorted(map(str, plotted.collect())) == sorted(map(str, output.plot(bf, "x", "p").collect()))
    marked = replay([bf.df], lambda s: output.markers(BarFrame(s), F.col("x") > F.col("open"), "m"))
    assert sorted(map(str, marked.collect())) == sorted(map(str, output.markers(bf, F.col("x") > F.col("open"), "m").collect()))


def test_request_steps():
    r = outputs.LastClosed()
    assert r.chart(1) is None
    r.request(2, (5.0,))
    assert r.chart(2) == (5.0,) and r.chart(9) == (5.0,)
    g = outputs.LastClosed(gaps=True)
    g.request(2, (5.0,))
    assert g.chart(2) == (5.0,) and g.chart(3) is None
    inside = outputs.Inside(max_size=2)
    inside.lower((0.0,))
    assert inside.chart(10) is None
    inside.lower((1.0,))
    inside.lower((2.0,))
    with pytest.raises(ValueError):
        inside.lower((3.0,))
    assert inside.chart(20) == (10, [(1.0,), (2.0,)])


def test_intents_of_an_outside_account(spark):
    bf = bars(spark, 4, 0.0)
    account = spark.createDataFrame([("a", -4.0)], "sym string, position double")
    rules = ({"type": "entry", "id": "L", "side": "long", "qty": 1.0, "when": F.col("time") == 0}, {"type": "close", "id": "L", "qty_percent": 50.0, "when": F.col("time") == 3600})
    got = sorted((r.sym, r.time, r.type, r.side, r.qty) for r in strategy.intents(bf, account, *rules).collect())
    assert got == [("a", 0, "entry", "long", 1.0), ("a", 3600, "close", "long", 2.0), ("b", 0, "entry", "long", 1.0)]
