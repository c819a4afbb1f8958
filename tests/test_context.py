"""Symbols, sessions, requests, and what a live session keeps."""

import pytest
from pyspark.sql import functions as F

from barframe.functions import collections as coll
from barframe.operators import context, output, recursive, steps
from barframe.operators.frame import BarFrame
from barframe.streaming import live, snapshot


def bars(spark):
    rows = [(s, 60 * i, 1.0 + i, None if i == 1 else True) for s in ("a", "b") for i in range(3)]
    return BarFrame(spark.createDataFrame(rows, "sym string, time long, close double, ismarket boolean"))


def test_symbols(spark):
    assert context.symbol("X:Y") == context.SYMBOL | {"tickerid": "X:Y", "prefix": "X", "ticker": "Y"}
    assert context.symbol({"ticker": "Y", "prefix": "Z"})["tickerid"] == "Z:Y" and context.symbol()["mintick"] == 1.0
    with pytest.raises(KeyError):
        context.symbol({"colour": "red"})
    table = context.symbols(spark, {"a": {"mintick": 0.5, "ticker": "A"}})
    got = {r.sym: (r.mintick, r.ticker) for r in context.with_symbols(bars(spark), table, "mintick", "ticker").df.collect()}
    assert got == {"a": (0.5, "A"), "b": (1.0, "")}


def test_session_state_and_failures(spark):
    got = [(r.ismarket, r.isfirstbar, r.islastbar) for r in context.session_state(bars(spark)).df.where("sym = 'a'").orderBy("time").collect()]
    assert got == [(True, True, False), (True, False, False), (True, False, True)]
    assert context.fail_when(bars(spark), F.col("close") > 9, "too high").df.count() == 6
    with pytest.raises(Exception, match="too high"):
        context.fail_when(bars(spark), F.col("close") > 2, "too high").df.collect()


def test_requests(spark):
    chart, week = bars(spark), BarFrame(spark.createDataFrame([("a", 0), ("a", 120)], "sym string, time long"))
    got = {r.sym: tuple(r)[1:] for r in context.request_report(chart, week, 60, 120).collect()}
    assert got == {"a": (3, 2, 1, 240), "b": (3, 0, 3, None)}
    assert [tuple(r) for r in context.finalized_through(week, 120, 200).collect()] == [("a", 120)]


def test_cells_seeds_and_previews():
    cell = steps.Cell(keep=2)
    for x in (1, 2, 3):
        cell.push(x)
    cell.value = 9
    assert [cell.ago(k) for k in range(4)] == [9, 3, 2, None] and snapshot.decode(snapshot.encode(cell)).ago(2) == 2
    with pytest.raises(IndexError):
        cell.ago(-1)
    session = live.Session(recursive.Ema(2))
    assert session.seed([(1, 1.0), (2, 3.0), (3, 5.0)], until=2) == [None, 2.0] and session.last == 2
    session.intrabar["seen"] = 1
    session.preview(lambda s: s.push(4.0))
    assert session.intrabar == {"seen": 1}
    session.close(3, lambda s: s.push(5.0))
    assert session.intrabar == {}


def test_reports_are_read_again_and_arrays_hold_objects(spark, tmp_path):
    report = output.Report().add(lines=output.plot(bars(spark), "close", "c"))
    report.write(str(tmp_path))
    assert sorted(map(str, output.Report.read(spark, str(tmp_path), ["lines"]).tables["lines"].collect())) == sorted(map(str, report.tables["lines"].collect()))
    assert spark.range(1).select(coll.array_of_objects(2).alias("x"), coll.array_of_objects(1, "l").alias("y")).first() == ([None, None], ["l"])
