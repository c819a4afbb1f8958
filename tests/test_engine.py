import pytest
from pyspark.sql import functions as F

from barframe.operators import drawing, output, ta
from barframe.operators.frame import BarFrame
from barframe.plans.engine import Engine, Limits, capabilities, provider_checks


def study(bf, p):
    n = p.get("length", "int", 2, minimum=1, maximum=50)
    bf = ta.sma(bf, "close", n, "m")
    return output.Report().add(lines=output.plot(bf, "m", "mean"), signals=output.emit_signal(bf, F.col("close") > F.col("m"), "up", "buy", payload=F.struct("m")))


ROWS = [{"sym": "a", "time": t, "open": 1.0, "high": 3.0, "low": 0.5, "close": 1.0 + t % 2, "volume": 1.0} for t in range(6)]


def test_run_validate_and_limits(spark):
    engine = Engine(spark)
    report = engine.run(study, ROWS, {"length": "3"})
    assert [r.value for r in report.series("mean").orderBy("time").collect()][:3] == [None, None, pytest.approx(4 / 3)]
    assert report.tables["signals"].first().payload.startswith('{"m":')
    assert engine.parameters(study)[0]["name"] == "length" and engine.validate(study) == []
    assert "Unresolved" in engine.validate(lambda bf, p: output.Report().add(lines=output.plot(bf, "nope", "x")))[0] or engine.validate(lambda bf, p: output.Report().add(lines=output.plot(bf, "nope", "x")))
    for bad in ({"length": 0}, {"length": "x"}, {"length": 1.5}, {"other": 1}):
        with pytest.raises(ValueError):
            engine.run(study, ROWS, bad)
    with pytest.raises(ValueError):
        Engine(spark, Limits(max_bars=3)).run(study, ROWS)
    assert "sma" in capabilities()["ta"] and "simulate" in capabilities()["strategy"]
    assert all(provider_checks(engine.bars(ROWS), ["a"], 0, 10).values())


def test_drawings(spark):
    bf = BarFrame(spark.createDataFrame([("a", t, float(t)) for t in range(4)], "sym string, time long, close double"))
    t = F.col("time")
    log = output.object_events(
        bf, drawing.new("line", "l1", t == 0, x1=t, y1=F.col("close")), drawing.new("line", "l2", t == 0, x1=t, y1=F.col("close")), drawing.new("linefill", "f", t == 1, line1="l1", line2="l2"),
        drawing.set_point("line", "l1", "xy2", drawing.Point(F.col("close"), time=t), t == 2), drawing.delete("l2", t == 3), drawing.new("table", "t", t == 1, columns=2, rows=2), drawing.cell("t", 0, 1, "hi", t == 2),
    )
    live = output.objects(log)
    assert {r.id for r in live.collect()} == {"l1", "f", "t"} and {r.id for r in drawing.without_orphans(live).collect()} == {"l1", "t"}
    assert {r.id: r.y2_number for r in drawing.value_of(live, "y2").collect()}["l1"] == 2.0
    with pytest.raises(KeyError):
        drawing.new("box", "b", nonsense=1)
    arrows = output.plot_arrows(bf.with_columns(d=F.col("close") - 2), "d", "a").orderBy("time").collect()
    assert [(r.direction, r.height) for r in arrows] == [("down", 100.0), ("down", 52.5), ("up", 52.5)]
