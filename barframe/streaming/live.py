"""Bars as a stream: the step classes of the batch operators as keyed state, with previews and late-bar handling.

``indicator_stream`` keeps one step object a symbol. A bar with ``confirmed`` false is a
preview: it is pushed through a copy, so state doesn't move. Bars that don't advance the
symbol's time are reported as late instead of failing the query. State is the text of
``snapshot``; Spark's checkpoint holds it, and a restart continues where it stopped. A
trigger's bars of one symbol are sorted in memory: bound them by the source's rate (such as
``maxFilesPerTrigger``) where a backlog may be long.
"""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.strategy import EVENT_FIELDS, EVENTS, Broker, Settings
from . import snapshot
from .outputs import Drawings, Inside, LastClosed

LIVE_BAR = "sym string, time long, open double, high double, low double, close double, volume double, confirmed boolean"


class Session:
    """One symbol's step and its clock, outside Spark or as a stream's state: close bars, preview them, save and restore."""

    def __init__(self, step: object, last: int | None = None):
        self.step, self.last = step, last
        #: what previews of one bar keep for each other; a closed bar clears it
        self.intrabar: dict = {}

    def late(self, time: int) -> bool:
        return self.last is not None and time <= self.last

    def close(self, time: int, advance: Callable[[object], object]) -> object:
        """``advance`` the step by a confirmed bar. A step that fails is left as it was."""
        if self.late(time):
            raise ValueError(f"time {time} doesn't come after {self.last}")
        moved = copy.deepcopy(self.step)
        out = advance(moved)
        self.step, self.last, self.intrabar = moved, time, {}
        return out

    def seed(self, bars: Iterable[tuple], until: int | None = None) -> list:
        """Close bars of history, (time, inputs...) in order, up to time ``until``."""
        return [self.close(t, lambda s, x=x: s.push(*x)) for t, *x in bars if until is None or t <= until]

    def preview(self, advance: Callable[[object], object]) -> object:
        return advance(copy.deepcopy(self.step))

    def save(self) -> str:
        return snapshot.encode((self.last, self.step))

    @classmethod
    def restore(cls, text: str) -> Session:
        last, step = snapshot.decode(text)
        return cls(step, last)


class Steps:
    """Several named steps as one: each takes its own inputs of a bar."""

    def __init__(self, steps: Mapping[str, tuple[Sequence[str], object]]):
        self.parts = {name: (tuple(inputs), step) for name, (inputs, step) in steps.items()}

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(c for inputs, _ in self.parts.values() for c in inputs))

    def push(self, *values) -> tuple:
        bar = dict(zip(self.inputs, values, strict=True))
        out = []
        for inputs, step in self.parts.values():
            v = step.push(*(bar[c] for c in inputs))
            out += v if isinstance(v, tuple) else (v,)
        return tuple(out)


snapshot.CLASSES["Steps"] = Steps


def _value(v) -> float | None:
    return None if v is None or v != v else float(v)


def _keyed(rows: DataFrame, order: Sequence[str], schema: str, begin: Callable[[], object], work: Callable[[Session, object], list[dict]]) -> DataFrame:
    """Rows of ``schema`` from ``work(session, row)`` for each row of a symbol, in order within a trigger."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # said by the caller about columns of missing values, for every symbol
        warnings.simplefilter("ignore", FutureWarning)
        session = Session.restore(state.get[0]) if state.exists else Session(begin())
        out = []
        for row in pd.concat(list(batches)).sort_values(list(order), kind="stable").itertuples(index=False):
            out += [{"sym": key[0]} | r for r in work(session, row)]
        state.update((session.save(),))
        yield pd.DataFrame([{n: r.get(n) for n in names} for r in out], columns=names)

    return rows.groupBy("sym").applyInPandasWithState(run, schema, "session string", "append", GroupStateTimeout.NoTimeout)


def _bars(bars: DataFrame, schema: str, begin: Callable[[], object], advance: Callable[[object, tuple], list[dict]]) -> DataFrame:
    def work(session: Session, bar) -> list[dict]:
        if session.late(bar.time):
            return [{"time": bar.time, "status": "late"}]
        if not bar.confirmed:
            return [{"status": "preview"} | r for r in advance(copy.deepcopy(session.step), bar)]
        rows = advance(session.step, bar)  # a failure stops the query, and the checkpoint still has the state before
        session.last = int(bar.time)
        return [{"status": "confirmed"} | r for r in rows]

    return _keyed(bars, ["time", "confirmed"], schema, begin, work)


def indicator_stream(bars: DataFrame, inputs: Sequence[str], out: Sequence[str], make: Callable[[], object]) -> DataFrame:
    """sym, time, status ('confirmed', 'preview', 'late') and ``out`` for each bar of LIVE_BAR (further columns may be inputs)."""

    def advance(step, bar) -> list[dict]:
        v = step.push(*(_value(getattr(bar, c)) for c in inputs))
        return [{"time": bar.time} | dict(zip(out, v if isinstance(v, tuple) else (v,), strict=True))]

    return _bars(bars, ", ".join(["sym string", "time long", "status string", *(f"{o} double" for o in out)]), make, advance)


def indicators_stream(bars: DataFrame, steps: Callable[[], Mapping[str, tuple[Sequence[str], object]]], out: Sequence[str]) -> DataFrame:
    """``indicator_stream`` of several steps, name -> (inputs, step), in one pass; ``out`` names their outputs in order."""
    return indicator_stream(bars, Steps(steps()).inputs, out, lambda: Steps(steps()))


def strategy_stream(bars: DataFrame, decide: Callable[[Broker, object], list[dict]], settings: Settings = Settings()) -> DataFrame:
    """Order events of a strategy that decides bar by bar: ``decide(broker, bar)`` returns commands and may keep values in ``broker.memory``."""

    def advance(broker, bar) -> list[dict]:
        commands = [{"seq": i} | c for i, c in enumerate(decide(broker, bar))]
        events = broker.bar(int(bar.time), bar.open, bar.high, bar.low, bar.close, commands)
        broker.events = []
        return [{k: e.get(k) for k in EVENT_FIELDS if k not in ("sym", "status")} | {"order_status": e.get("status")} for e in events]

    return _bars(bars, EVENTS.replace("`status` string", "`order_status` string") + ", status string", lambda: Broker(settings), advance)


def drawing_stream(log: DataFrame, keep_last: int | None = None) -> DataFrame:
    """sym, id, kind, time, alive, props for each change of an object, from a stream of OBJECT_EVENTS.

    ``output.object_events`` and the rules of ``drawing`` make the log from streamed bars as from a table of them.
    """

    def work(session: Session, e) -> list[dict]:
        return session.step.push(int(e.time), e.id, e.op, e.kind, None if e.props is None else dict(e.props))

    return _keyed(log, ["time", "seq"], "sym string, id string, kind string, time long, alive boolean, props map<string,string>", lambda: Drawings(keep_last), work)


def security_stream(chart: DataFrame, requested: DataFrame, values: Sequence[str], chart_step: int, requested_step: int, gaps: bool = False, lookahead: bool = False, prefix: str = "req_") -> DataFrame:
    """sym, time and ``values`` of the requested bars at each bar of a streamed chart; both are streams of bars by symbol.

    A requested bar shows once it has closed, as in ``align.security``. Within a trigger rows are taken by
    time; a requested bar that comes in a later trigger shows from then on.
    """
    delay = 0 if lookahead else max(requested_step - chart_step, 0)
    none = [F.lit(None).cast("double").alias(v) for v in values]
    rows = requested.select("sym", (F.col("time") + delay).alias("time"), F.lit(0).alias("side"), *(F.col(v).cast("double").alias(v) for v in values))
    rows = rows.union(chart.select("sym", "time", F.lit(1).alias("side"), *none))

    def work(session: Session, r) -> list[dict]:
        if not r.side:
            session.step.request(int(r.time), tuple(_value(getattr(r, v)) for v in values))
            return []
        shown = session.step.chart(int(r.time)) or (None,) * len(values)
        return [{"time": r.time} | {prefix + v: x for v, x in zip(values, shown, strict=True)}]

    schema = ", ".join(["sym string", "time long", *(f"{prefix}{v} double" for v in values)])
    return _keyed(rows, ["time", "side"], schema, lambda: LastClosed(gaps), work)


def security_lower_stream(chart: DataFrame, lower: DataFrame, values: Sequence[str], prefix: str = "ltf_", max_size: int | None = None) -> DataFrame:
    """sym, time and arrays of the lower bars of each chart bar, told when the next chart bar begins."""
    none = [F.lit(None).cast("double").alias(v) for v in values]
    rows = chart.select("sym", "time", F.lit(0).alias("side"), *none).union(lower.select("sym", "time", F.lit(1).alias("side"), *(F.col(v).cast("double").alias(v) for v in values)))

    def work(session: Session, r) -> list[dict]:
        if r.side:
            session.step.lower(tuple(_value(getattr(r, v)) for v in values))
            return []
        done = session.step.chart(int(r.time))
        return [] if done is None else [{"time": done[0]} | {prefix + v: [x[k] for x in done[1]] for k, v in enumerate(values)}]

    schema = ", ".join(["sym string", "time long", *(f"{prefix}{v} array<double>" for v in values)])
    return _keyed(rows, ["time", "side"], schema, lambda: Inside(max_size), work)


def bars_from_tick_stream(ticks: DataFrame, sym: str, ts: str, value: str, every: str, late: str = "1 hour") -> DataFrame:
    """Bars of closed windows from a stream of ticks, each once; ticks later than ``late`` are dropped with the watermark."""
    order = F.struct(F.col(ts), F.col(value))
    return (
        ticks.withWatermark(ts, late).groupBy(F.window(ts, every), F.col(sym).alias("sym"))
        .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("sym", F.unix_timestamp("window.start").alias("time"), "open", "high", "low", "close", "volume", F.lit(True).alias("confirmed"))
    )
