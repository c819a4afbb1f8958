"""Order simulation: commands on bars become fills, trades, equity and an order lifecycle.

``Broker`` is a state machine over one symbol's bars; it holds open lots, resting orders
and running sums only. ``simulate`` streams bars in order through one broker a symbol, so
a task never holds a symbol's bars. The streaming engine keeps the same object as state.

A market command fills on its own bar at the close (or its own price). Resting orders
are tried on the bar they are given and later; with ``on_close`` new ones see only the
close. Brackets (``exit``) guard lots that were open when the bar began.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import BarFrame

LONG, SHORT = "long", "short"
COMMAND = (
    "struct<seq:int,type:string,id:string,side:string,qty:double,qty_percent:double,price:double,limit:double,stop:double,from_entry:string,oca_name:string,oca_type:string,comment:string>"
)
_COMMAND_FIELDS = [f.split(":")[0] for f in COMMAND[7:-1].split(",")]


@dataclass(frozen=True)
class Settings:
    initial_capital: float = 100_000.0
    pyramiding: int = 0
    slippage: int = 0
    mintick: float = 0.01
    #: None, 'percent', 'cash_per_order' or 'cash_per_contract'
    commission_type: str | None = None
    commission_value: float = 0.0
    #: ticks by which a price must pass a limit
    verify_limits: int = 0
    on_close: bool = False
    #: 'stop_first' or 'limit_first' where a bar reaches both sides of a bracket
    same_bar: str = "stop_first"
    #: 'priority', 'open_high_low_close' or 'open_low_high_close'
    path: str = "priority"
    margin_long: float = 0.0
    margin_short: float = 0.0
    point_value: float = 1.0
    allow: str = "all"
    max_drawdown: float | None = None
    max_drawdown_type: str = "percent"
    max_intraday_loss: float | None = None
    max_intraday_loss_type: str = "percent"
    max_position_size: float | None = None
    max_intraday_filled_orders: int | None = None
    #: closed trades that a broker remembers, for decisions bar by bar
    keep_trades: int = 200


@dataclass
class Lot:
    id: str
    sign: int
    qty: float
    price: float
    time: int
    index: int
    commission: float
    comment: str
    number: int = 0


class Trades:
    """Trades by number, as a decision on a bar sees them: from the first, or from the last if negative; None where there is none.

    ``rows`` are the last ones of ``count``.
    """

    def __init__(self, rows: list[dict], count: int | None = None):
        self.rows, self.count = rows, len(rows) if count is None else count

    def get(self, name: str, k: int):
        k += self.count if k < 0 else 0
        at = k - (self.count - len(self.rows))
        return self.rows[at].get(name) if 0 <= at < len(self.rows) and k < self.count else None

    def profit_percent(self, k: int) -> float | None:
        profit, value = self.get("profit", k), (self.get("qty", k) or 0.0) * (self.get("entry_price", k) or 0.0)
        return None if profit is None or not value else 100 * profit / value

    def size(self, k: int) -> float | None:
        """The quantity, negative for a short trade."""
        qty = self.get("qty", k)
        return None if qty is None else qty if self.get("side", k) == LONG else -qty

    def values(self, name: str) -> list:
        return [r.get(name) for r in self.rows]


for _name in ("qty", "side", "profit", "net_profit", "commission", "entry_price", "exit_price", "entry_time", "exit_time", "entry_bar", "exit_bar", "entry_id", "exit_id", "entry_comment", "exit_comment"):
    setattr(Trades, _name, lambda self, k, _name=_name: self.get(_name, k))


@dataclass
class Broker:
    settings: Settings
    size: float = 0.0
    lots: list[Lot] = field(default_factory=list)
    resting: list[dict] = field(default_factory=list)
    wins: float = 0.0
    losses: float = 0.0
    fees: float = 0.0
    index: int = -1
    day: int | None = None
    peak: float | None = None
    day_peak: float | None = None
    day_fills: int = 0
    drawdown_lock: bool = False
    day_lock: bool = False
    last_close: float = 0.0
    events: list[dict] = field(default_factory=list)
    lot_count: int = 0
    trade_count: int = 0
    closed: list[dict] = field(default_factory=list)
    #: values that a strategy keeps between bars
    memory: dict = field(default_factory=dict)

    # ---- trades --------------------------------------------------------------------

    @property
    def closed_trades(self) -> Trades:
        return Trades(self.closed, self.trade_count)

    def open_trades(self, price: float) -> Trades:
        """One trade a lot, valued at ``price``."""
        rows = []
        for x in self.lots:
            profit = x.sign * x.qty * (price - x.price) * self.settings.point_value
            rows.append({"side": LONG if x.sign > 0 else SHORT, "qty": x.qty, "entry_price": x.price, "entry_time": x.time, "entry_bar": x.index, "entry_id": x.id, "entry_comment": x.comment, "commission": x.commission, "profit": profit, "net_profit": profit - x.commission})
        return Trades(rows)

    # ---- money -------------------------------------------------------------------

    @property
    def average(self) -> float | None:
        held = sum(x.qty for x in self.lots)
        return sum(x.qty * x.price for x in self.lots) / held if held else None

    def open_profit(self, price: float) -> float:
        return sum(x.sign * x.qty * (price - x.price) for x in self.lots) * self.settings.point_value

    def equity(self, price: float) -> float:
        return self.settings.initial_capital + self.wins + self.losses - self.fees + self.open_profit(price)

    def _slipped(self, price: float, sign: int) -> float:
        return price + sign * self.settings.slippage * self.settings.mintick

    def _fee(self, qty: float, price: float) -> float:
        s = self.settings
        if s.commission_type == "percent":
            return qty * price * s.commission_value / 100 * s.point_value
        return s.commission_value * (qty if s.commission_type == "cash_per_contract" else 1.0) if s.commission_type else 0.0

    def _affordable(self, after: float, price: float, close: float) -> bool:
        share = self.settings.margin_long if after > 0 else self.settings.margin_short
        shrinks = after == 0 or (after > 0) == (self.size > 0) and abs(after) <= abs(self.size)
        return shrinks or not share or abs(after * price) * self.settings.point_value * share / 100 <= max(self.equity(close), 0.0)

    @property
    def locked(self) -> bool:
        return self.drawdown_lock or self.day_lock

    # ---- events --------------------------------------------------------------------

    def _tell(self, kind: str, time: int, o: Mapping[str, Any], **more) -> None:
        self.events.append({"kind": kind, "time": time, "id": o.get("id") or "", "type": o.get("type"), "side": o.get("side"), "comment": o.get("comment") or "", **more})

    def _fate(self, status: str, time: int, o: Mapping[str, Any], **more) -> None:
        self._tell("lifecycle", time, o, status=status, submitted_time=o.get("submitted", time), **more)

    # ---- fills -----------------------------------------------------------------------

    def _fill(self, time: int, o: dict, signed: float, price: float, only: str = "", reason: str | None = None, asked: float | None = None) -> None:
        """Trade ``signed`` at ``price``: close opposite lots first in, first out (or those of entry ``only``), then open a lot with the rest."""
        sign, left = (1 if signed > 0 else -1), abs(signed)
        whole = left
        fee = self._fee(left, price)
        self.fees += fee
        for lot in [x for x in self.lots if x.sign == -sign and (not only or x.id == only)]:
            qty = min(lot.qty, left)
            if qty <= 0:
                break
            profit = lot.sign * qty * (price - lot.price) * self.settings.point_value
            if profit >= 0:
                self.wins += profit
            else:
                self.losses += profit
            paid = lot.commission * qty / lot.qty + fee * qty / whole
            lot.commission -= lot.commission * qty / lot.qty
            lot.qty = round(lot.qty - qty, 8)
            left = round(left - qty, 8)
            trade = {"side": LONG if lot.sign > 0 else SHORT, "entry_id": lot.id, "entry_time": lot.time, "exit_time": time, "entry_bar": lot.index, "exit_bar": self.index, "qty": qty, "entry_price": lot.price, "profit": profit, "commission": paid, "net_profit": profit - paid}
            self._tell("trade", time, o, **trade, price=price, lot=lot.number)
            self.trade_count += 1
            self.closed.append(trade | {"exit_price": price, "exit_id": o.get("id") or "", "entry_comment": lot.comment, "exit_comment": o.get("comment") or ""})
            del self.closed[: max(len(self.closed) - self.settings.keep_trades, 0)]
        self.lots = [x for x in self.lots if x.qty > 0]
        if left > 0 and not only:
            self.lots.append(Lot(o.get("id") or "", sign, left, price, time, self.index, fee * left / whole, o.get("comment") or "", self.lot_count))
            self._tell("lot", time, o, side=LONG if sign > 0 else SHORT, entry_id=o.get("id") or "", entry_time=time, entry_bar=self.index, qty=left, entry_price=price, commission=fee * left / whole, lot=self.lot_count)
            self.lot_count += 1
        self.size = round(sum(x.sign * x.qty for x in self.lots), 8)
        self._tell("order", time, o, qty=o.get("filled", whole), price=round(price, 8), position_after=self.size, reason=reason, commission=fee)
        self._fate("filled", time, o, requested_qty=asked if asked is not None else o.get("qty"), qty=o.get("filled", whole), price=round(price, 8), position_after=self.size, reason=reason)
        if o["type"] in ("entry", "order"):
            self.day_fills += 1
            most = self.settings.max_intraday_filled_orders
            if most is not None and self.day_fills >= most:
                self.day_lock = True
        self._linked(time, o, whole)

    def _linked(self, time: int, o: dict, qty: float) -> None:
        """One-cancels-all groups: the rest is canceled, or reduced by what was filled."""
        name, kind = o.get("oca_name"), o.get("oca_type")
        if not name or kind not in ("cancel", "reduce"):
            return
        for other in [x for x in self.resting if x.get("oca_name") == name and x.get("oca_type") == kind and x is not o]:
            other["qty"] = max(other["qty"] - qty, 0.0) if kind == "reduce" else 0.0
            if other["qty"] <= 0:
                self.resting.remove(other)
                self._fate("canceled", time, other, canceled_by=o.get("id"))

    def _enter(self, time: int, o: dict, price: float, close: float, reason: str | None = None, rests: bool = False) -> bool:
        """Fill an entry (which replaces an opposite position) or a plain order (which nets); False: it stays."""
        sign = 1 if o["side"] == LONG else -1
        price = self._slipped(price, sign)
        asked = qty = float(o.get("qty") or 0.0)
        same = self.size * sign > 0
        if o["type"] == "entry":
            if self.settings.allow in (LONG, SHORT) and o["side"] != self.settings.allow:
                self._fate("rejected", time, o, reason="direction_not_allowed")
                return True
            if same and not rests and len(self.lots) > self.settings.pyramiding:
                self._fate("rejected", time, o, reason="pyramiding_exceeded")
                return True
            if self.settings.max_position_size is not None:
                qty = min(qty, max(self.settings.max_position_size - (abs(self.size) if same else 0.0), 0.0))
            if qty <= 0:
                self._fate("rejected", time, o, reason="max_position_size")
                return True
            after = self.size + sign * qty if same else sign * qty
        else:
            after = self.size + sign * qty
        if not self._affordable(after, price, close):
            if not rests:
                self._fate("rejected", time, o, reason="margin")
            return not rests
        o["filled"] = qty
        self._fill(time, o, after - self.size, price, reason=reason, asked=asked)
        return True

    def _leave(self, time: int, o: dict, price: float, reason: str | None = None, guarded: dict[int, float] | None = None) -> None:
        """Close lots: all, or those of one entry; by quantity, by percent, or whole."""
        if not self.size:
            return
        only = (o.get("from_entry") if o["type"] == "exit" else o.get("id") if o["type"] == "close" else "") or ""
        target = sum(x.qty for x in self.lots if not only or x.id == only)
        asked = o["qty"] if o.get("qty") is not None else target * o["qty_percent"] / 100 if o.get("qty_percent") is not None else target
        qty = min(asked, target)
        if qty > 0:
            sign = -1 if self.size > 0 else 1
            o["filled"] = qty
            self._fill(time, o, sign * qty, self._slipped(price, sign), only, reason, asked)
            if not only:
                self.lots = [x for x in self.lots if x.sign * sign < 0]
                self.size = round(sum(x.sign * x.qty for x in self.lots), 8)

    # ---- triggers ----------------------------------------------------------------------

    def _both(self, stop_at: str) -> bool:
        """Whether the stop side goes first where a bar reaches both; ``stop_at``: 'high' or 'low'."""
        if self.settings.path == "open_high_low_close":
            return stop_at == "high"
        if self.settings.path == "open_low_high_close":
            return stop_at == "low"
        return self.settings.same_bar != "limit_first"

    def _trigger(self, o: dict, sign: int, op: float, hi: float, lo: float, cl: float, bracket: bool) -> tuple[str, float] | None:
        """(reason, price) if a buy (sign 1) or sell order is reached. Gaps fill at the open."""
        limit, stop = o.get("limit"), o.get("stop")
        pad = self.settings.verify_limits * self.settings.mintick
        far, near = (hi, lo) if sign > 0 else (lo, hi)  # a buy's stop waits above, its limit below
        at_stop = stop is not None and sign * (far - stop) >= 0
        at_limit = limit is not None and sign * (limit - near) >= pad
        if limit is not None and stop is not None and not bracket:
            return self._stop_limit(o, sign, op, hi, lo, cl, pad)
        if at_stop and (not at_limit or self._both("high" if sign > 0 else "low")):
            return "stop", max(stop, op) if sign > 0 else min(stop, op)
        if at_limit:
            return "limit", min(limit, op) if sign > 0 else max(limit, op)
        return None

    def _path(self, op: float, hi: float, lo: float, cl: float) -> list[float]:
        """The bar's prices in the order that they are taken to come: the nearer end first, unless settings say otherwise."""
        up = self.settings.path == "open_high_low_close" or self.settings.path == "priority" and hi - op < op - lo
        return [op, *((hi, lo) if up else (lo, hi)), cl]

    def _stop_limit(self, o: dict, sign: int, op: float, hi: float, lo: float, cl: float, pad: float) -> tuple[str, float] | None:
        """The stop arms the limit: the price path is cut where it first reaches the stop, and the limit looks at the rest."""
        path = self._path(op, hi, lo, cl)
        if not o.get("armed"):
            cut = next((k for k, p in enumerate(path) if sign * p >= sign * o["stop"]), None)
            if cut is None:
                return None
            o["armed"] = True
            path = [o["stop"], *path[cut:]] if cut else path
        good = [sign * (o["limit"] - p) >= pad for p in path]
        return ("limit", path[0] if good[0] else o["limit"]) if any(good) else None

    def _try_resting(self, time: int, op: float, hi: float, lo: float, cl: float, new: bool | None) -> None:
        for o in list(self.resting):
            if o not in self.resting or self.locked or new is not None and (o["submitted"] == time) != new:
                continue
            seen = (cl, cl, cl) if self.settings.on_close and o["submitted"] == time else (op, hi, lo)
            hit = self._trigger(o, 1 if o["side"] == LONG else -1, *seen, cl, False)
            if hit and self._enter(time, o, hit[1], cl, hit[0], rests=True) and o in self.resting:
                self.resting.remove(o)

    # ---- one bar ---------------------------------------------------------------------------

    def bar(self, time: int, op: float, hi: float, lo: float, cl: float, commands: list[dict]) -> list[dict]:
        self.events, self.index = [], self.index + 1
        self._start_day(time)
        began = {id(x): x.qty for x in self.lots}
        if self.settings.on_close:
            self._try_resting(time, op, hi, lo, cl, False)
        for c in sorted(commands, key=lambda c: c["seq"]):
            self._command(dict(c), time, op, hi, lo, cl, began)
        self._try_resting(time, op, hi, lo, cl, True if self.settings.on_close else None)
        self._check_loss(time, hi, lo, cl)
        equity = self.equity(cl)
        self.peak, self.day_peak, self.last_close = max(self.peak, equity), max(self.day_peak, equity), cl
        s = self.settings
        self.drawdown_lock |= self._lost(equity, self.peak, s.max_drawdown, s.max_drawdown_type)
        self.day_lock |= self._lost(equity, self.day_peak, s.max_intraday_loss, s.max_intraday_loss_type)
        self.events.append({"kind": "equity", "time": time, "position_after": self.size, "price": self.average, "equity": equity, "net_profit": self.wins + self.losses - self.fees, "open_profit": self.open_profit(cl), "gross_profit": self.wins, "gross_loss": self.losses, "commission": self.fees, "locked": self.locked})
        return self.events

    def _start_day(self, time: int) -> None:
        day = time // 86_400
        start = self.equity(self.last_close) if self.index else self.settings.initial_capital
        self.peak = start if self.peak is None else self.peak
        if day != self.day:
            self.day, self.day_peak, self.day_fills, self.day_lock = day, start, 0, False

    @staticmethod
    def _lost(equity: float, peak: float, limit: float | None, kind: str) -> bool:
        return limit is not None and peak - equity >= (limit if kind == "cash" else peak * limit / 100) and peak > equity

    def _check_loss(self, time: int, hi: float, lo: float, cl: float) -> None:
        """An intraday loss at the bar's worst price closes everything there."""
        s = self.settings
        worst = lo if self.size > 0 else hi
        if self.size and self._lost(self.equity(worst), self.day_peak, s.max_intraday_loss, s.max_intraday_loss_type):
            self.day_lock = True
            self._leave(time, {"type": "close_all", "id": "risk.max_intraday_loss", "side": "flat"}, worst)

    def _command(self, c: dict, time: int, op: float, hi: float, lo: float, cl: float, began: dict[int, float]) -> None:
        kind = c["type"]
        c["submitted"] = time
        if kind in ("entry", "order"):
            if self.locked:
                self._fate("rejected", time, c, reason="risk_locked")
            elif c.get("limit") is None and c.get("stop") is None:
                self._enter(time, c, c["price"] if c.get("price") is not None else cl, cl)
            else:
                self._rest(time, c)
        elif kind in ("cancel", "cancel_all"):
            for o in [x for x in self.resting if kind == "cancel_all" or x.get("id") == c.get("id")]:
                self.resting.remove(o)
                self._fate("canceled", time, o, canceled_by=kind)
        elif kind in ("close", "close_all"):
            c["side"] = "flat"
            self._leave(time, c, c["price"] if c.get("price") is not None else cl)
        elif kind == "exit" and self.size and any(id(x) in began for x in self.lots):
            c["side"] = "flat"
            if c.get("stop") is None and c.get("limit") is None:
                self._leave(time, c, c["price"] if c.get("price") is not None else cl)
            elif hit := self._trigger(c, -1 if self.size > 0 else 1, op, hi, lo, cl, True):
                self._leave(time, c, hit[1], hit[0])

    def _rest(self, time: int, c: dict) -> None:
        """A resting order replaces its namesake."""
        if c["type"] == "entry" and self.size * (1 if c["side"] == LONG else -1) > 0 and len(self.lots) > self.settings.pyramiding:
            self._fate("rejected", time, c, reason="pyramiding_exceeded")
            return
        for o in [x for x in self.resting if x.get("id") == c.get("id") and x["type"] == c["type"]]:
            self.resting.remove(o)
            self._fate("canceled", time, o, canceled_by=c.get("id"))
        self.resting.append(c)
        self._fate("pending", time, c, qty=c.get("qty"), limit=c.get("limit"), stop=c.get("stop"))


EVENT_FIELDS = {
    "sym": "string", "kind": "string", "time": "long", "id": "string", "type": "string", "side": "string", "qty": "double", "price": "double", "position_after": "double", "reason": "string", "comment": "string",
    "commission": "double", "status": "string", "submitted_time": "long", "requested_qty": "double", "canceled_by": "string", "limit": "double", "stop": "double", "entry_id": "string", "entry_time": "long", "exit_time": "long",
    "entry_bar": "long", "exit_bar": "long", "entry_price": "double", "profit": "double", "net_profit": "double", "equity": "double", "open_profit": "double", "gross_profit": "double", "gross_loss": "double", "locked": "boolean", "lot": "long",
}
EVENTS = ", ".join(f"`{k}` {v}" for k, v in EVENT_FIELDS.items())
_ARROW = pa.schema([(k, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[v]) for k, v in EVENT_FIELDS.items()])


def event_batch(sym: str, events: list[dict]) -> pa.RecordBatch:
    whole = lambda v: round(v, 8) if isinstance(v, float) else v
    return pa.RecordBatch.from_pylist([{k: whole(e.get(k)) for k in EVENT_FIELDS} | {"sym": e.get("sym", sym)} for e in events], schema=_ARROW)


def with_commands(bf: BarFrame, *rules: dict) -> BarFrame:
    """``bf`` with ``commands``: for each bar those whose ``when`` holds, in the order of ``rules``.

    A rule has ``type`` and may have any other COMMAND field, as a literal or a column.
    """
    kinds = dict(x.split(":") for x in COMMAND[7:-1].split(","))
    made = []
    for k, rule in enumerate(rules):
        value = lambda f, r=rule, n=k: F.lit(n) if f == "seq" else r[f] if isinstance(r.get(f), Column) else F.lit(r.get(f))
        row = F.struct(*(value(f).cast(kinds[f]).alias(f) for f in _COMMAND_FIELDS))
        made.append(F.when(F.coalesce(rule.get("when", F.lit(True)), F.lit(False)), row))
    return bf.with_columns(commands=F.filter(F.array(*made), lambda c: c.isNotNull()))


def commands(bf: BarFrame, *rules: dict) -> DataFrame:
    """(sym, time, commands), as ``with_commands`` gives them, for bars of another table."""
    return with_commands(bf, *rules).df.select(*bf.keys, bf.order, "commands")


def simulate(bf: BarFrame, given: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """EVENTS of all symbols: orders, trades, lifecycle and one equity row a bar.

    ``given``: (sym, time, commands), or None where ``bf`` has the commands as a column.
    """
    bars = bf.df if given is None else bf.df.join(given, ["sym", bf.order], "left")
    rows = bars.select("sym", F.col(bf.order).alias("time"), "open", "high", "low", "close", F.coalesce("commands", F.array().cast(f"array<{COMMAND}>")).alias("commands"))
    rows = rows.where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")

    def run(batches):
        sym, broker = None, None
        for batch in batches:
            stream = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for s, group in groupby(stream, key=lambda r: r[0]):
                if broker is None or s != sym:
                    sym, broker = s, Broker(settings)
                events = []
                for r in group:
                    events += broker.bar(*r[1:7])
                yield event_batch(s, events)

    # a window asks for just the deal and the order that the broker needs, and takes those that are there
    ordered = rows.withColumn("_order", F.row_number().over(Window.partitionBy("sym").orderBy("time")))
    return ordered.mapInArrow(run, EVENTS)


# ---- tables of events ---------------------------------------------------------------------------


def orders(events: DataFrame) -> DataFrame:
    return events.where("kind = 'order'").select("sym", "time", "id", "type", "side", "qty", "price", "position_after", "reason", "comment", "commission")


def trades(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select("sym", "entry_time", "exit_time", "entry_bar", "exit_bar", "entry_id", F.col("id").alias("exit_id"), "side", "qty", "entry_price", F.col("price").alias("exit_price"), "profit", "commission", "net_profit", F.round(F.try_divide(F.col("profit") * 100, F.col("qty") * F.col("entry_price")), 8).alias("profit_percent"))


def open_trades(events: DataFrame, last: DataFrame) -> DataFrame:
    """Lots that are still open, valued at ``last`` (sym, close)."""
    gone = events.where("kind = 'trade'").groupBy("sym", "lot").agg(F.sum("qty").alias("gone"))
    lots = events.where("kind = 'lot'").select("sym", "lot", "entry_id", "entry_time", "entry_bar", "side", F.col("qty").alias("whole"), "entry_price", "commission", "comment")
    held = lots.join(gone, ["sym", "lot"], "left").withColumn("qty", F.round(F.col("whole") - F.coalesce("gone", F.lit(0.0)), 8)).where("qty > 0")
    sign = F.when(F.col("side") == LONG, 1).otherwise(-1)
    valued = held.join(last.select("sym", "close"), "sym").withColumn("profit", sign * F.col("qty") * (F.col("close") - F.col("entry_price")))
    percent = F.round(F.try_divide(F.col("profit") * 100, F.col("qty") * F.col("entry_price")), 8)
    return valued.select("sym", "lot", "entry_id", "entry_time", "entry_bar", "side", "qty", "entry_price", (F.col("commission") * F.col("qty") / F.col("whole")).alias("commission"), F.col("comment").alias("entry_comment"), "profit", percent.alias("profit_percent"))


def intents(bf: BarFrame, account: DataFrame, *rules: dict) -> DataFrame:
    """What a strategy asks of an outside account, without simulating it: commands on each bar as rows.

    ``account``: sym, position (signed). Quantities in percent of the position become quantities;
    closes and exits of a flat account are no intents.
    """
    rows = with_commands(bf, *rules).df.select("sym", F.col(bf.order).alias("time"), F.explode("commands").alias("c")).select("sym", "time", "c.*")
    held = rows.join(account.select("sym", "position"), "sym", "left").withColumn("position", F.coalesce("position", F.lit(0.0)))
    leaving = F.col("type").isin("close", "close_all", "exit")
    share = F.coalesce("qty", F.abs("position") * F.coalesce("qty_percent", F.lit(100.0)) / 100)
    qty = F.when(leaving, F.least(share, F.abs("position"))).otherwise(F.col("qty"))
    side = F.when(leaving, F.when(F.col("position") > 0, SHORT).otherwise(LONG)).otherwise(F.col("side"))
    return held.where(~leaving | (F.col("position") != 0)).select("sym", "time", "seq", "type", "id", side.alias("side"), qty.alias("qty"), "price", "limit", "stop", "from_entry", "oca_name", "oca_type", "comment", "position")


def lifecycle(events: DataFrame) -> DataFrame:
    return events.where("kind = 'lifecycle'").select("sym", "time", "id", "type", "side", "status", "submitted_time", "requested_qty", "qty", "price", "position_after", "reason", "canceled_by", "limit", "stop")


def equity(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select("sym", "time", F.col("position_after").alias("position_size"), F.col("price").alias("position_avg_price"), "equity", "net_profit", "open_profit", "gross_profit", "gross_loss", "commission", "locked")


def summary(events: DataFrame) -> DataFrame:
    """The last equity row of each symbol, with counts of trades."""
    last = equity(events).groupBy("sym").agg(F.max_by(F.struct("equity", "net_profit", "open_profit", "gross_profit", "gross_loss", "commission", "position_size", "locked"), "time").alias("s"))
    counts = trades(events).groupBy("sym").agg(F.count("*").alias("closed_trades"), F.count_if(F.col("profit") > 0).alias("winning_trades"))
    return last.join(counts, "sym", "left").select("sym", "s.*", F.coalesce("closed_trades", F.lit(0)).alias("closed_trades"), F.coalesce("winning_trades", F.lit(0)).alias("winning_trades"))
