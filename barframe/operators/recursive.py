"""Operators whose value depends on their own last value: averages with memory, and state machines.

Each is a small step class: ``push`` takes a bar's inputs (``None`` is missing) and
returns its outputs. ``scan`` runs steps over bars streamed in order, so a task holds one
state and never a symbol's bars; the streaming engine keeps the same objects as its state.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .frame import BarFrame, Src, positive

Value = float | None


class Average:
    """a * x + (1 - a) * last, begun with the mean of the first n values. Missing: nothing, or the last value again."""

    def __init__(self, n: int, alpha: float, repeat: bool = False):
        self.n, self.alpha, self.repeat = positive(n), alpha, repeat
        self.count, self.total, self.value = 0, 0.0, None

    def push(self, x: Value) -> Value:
        if x is None:
            return self.value if self.repeat else None
        if self.count < self.n:
            self.count += 1
            self.total += x
            if self.count == self.n:
                self.value = self.total / self.n
        else:
            self.value = self.alpha * x + (1 - self.alpha) * self.value
        return self.value


def Ema(n: int) -> Average:  # noqa: N802
    return Average(n, 2.0 / (n + 1))


def Rma(n: int, repeat: bool = False) -> Average:  # noqa: N802
    return Average(n, 1.0 / n, repeat)


class DynamicAverage:
    """An average whose length is a column: begun with the first value; a length of 0 or less, or none, starts over."""

    def __init__(self, ema: bool):
        self.ema, self.value = ema, None

    def push(self, x: Value, length: Value) -> Value:
        if length is None or length <= 0:
            self.value = None
        elif x is not None:
            a = min(max((2.0 / (length + 1)) if self.ema else 1.0 / length, 0.0), 1.0)
            self.value = x if self.value is None else a * x + (1 - a) * self.value
        return self.value


class Rsi:
    def __init__(self, n: int):
        self.n, self.bars, self.last, self.gain, self.loss = n, 0, None, Rma(n), Rma(n)

    def push(self, x: Value) -> Value:
        d = None if x is None or self.last is None else x - self.last
        self.last, self.bars = x, self.bars + 1
        gain = self.gain.push(None if d is None else max(d, 0.0))
        loss = self.loss.push(None if d is None else max(-d, 0.0))
        if d is None or gain is None or self.bars <= self.n:
            return None
        return 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)


class Macd:
    """Line, signal, histogram."""

    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def push(self, x: Value) -> tuple[Value, Value, Value]:
        a, b = self.fast.push(x), self.slow.push(x)
        line = None if a is None or b is None else a - b
        signal = self.signal.push(line)
        return line, signal, None if line is None or signal is None else line - signal


class Tsi:
    def __init__(self, short: int, long: int):
        self.last, self.parts = None, [(Ema(long), Ema(short)) for _ in range(2)]

    def push(self, x: Value) -> Value:
        d = None if x is None or self.last is None else x - self.last
        self.last = x
        a, b = (two.push(one.push(v)) for (one, two), v in zip(self.parts, (d, None if d is None else abs(d)), strict=True))
        return None if a is None or not b else a / b


def true_range(high: Value, low: Value, last: Value, strict: bool) -> Value:
    if high is None or low is None or strict and last is None:
        return None
    return high - low if last is None else max(high - low, abs(high - last), abs(low - last))


class Atr:
    def __init__(self, n: int):
        self.last, self.mean = None, Rma(n, True)

    def push(self, high: Value, low: Value, close: Value) -> Value:
        out = self.mean.push(true_range(high, low, self.last, False))
        self.last = close
        return out


class DynamicAtr:
    def __init__(self):
        self.last, self.mean = None, DynamicAverage(False)

    def push(self, high: Value, low: Value, close: Value, length: Value) -> Value:
        out = self.mean.push(true_range(high, low, self.last, False), length)
        self.last = close
        return out


class Dmi:
    """+DI, -DI, ADX."""

    def __init__(self, n: int, adx: int):
        self.last = (None, None, None)
        self.range, self.plus, self.minus, self.adx = Rma(n, True), Rma(n, True), Rma(n, True), Rma(adx, True)
        self.di: list[Value] = [None, None]

    def push(self, high: Value, low: Value, close: Value) -> tuple[Value, Value, Value]:
        h, lo, c = self.last
        self.last = (high, low, close)
        up = None if high is None or h is None else high - h
        down = None if low is None or lo is None else lo - low
        tr = self.range.push(true_range(high, low, c, True))
        # a comparison with a missing move is false
        plus = None if up is None else up if down is not None and up > down and up > 0 else 0.0
        minus = None if down is None else down if up is not None and down > up and down > 0 else 0.0
        for i, move in enumerate((self.plus.push(plus), self.minus.push(minus))):
            if move is not None and tr:
                self.di[i] = 100.0 * move / tr
        p, m = self.di
        total = None if p is None or m is None else p + m
        adx = self.adx.push(None if total is None else abs(p - m) / (total or 1.0))
        return p, m, None if adx is None else 100.0 * adx


class Keltner:
    """Upper, middle, lower."""

    def __init__(self, n: int, mult: float, use_true_range: bool = True, width: str = "ema"):
        if width not in ("ema", "atr") or width == "atr" and not use_true_range:
            raise ValueError("width is 'ema', or 'atr' with use_true_range")
        self.mult, self.strict, self.last = mult, use_true_range, None
        self.mid, self.width = Ema(n), (Atr(n) if width == "atr" else Ema(n))

    def push(self, high: Value, low: Value, close: Value, basis: Value) -> tuple[Value, Value, Value]:
        mid = self.mid.push(basis)
        if isinstance(self.width, Atr):
            width = self.width.push(high, low, close)
        else:
            span = true_range(high, low, self.last, True) if self.strict else None if high is None or low is None else high - low
            width = self.width.push(span)
        self.last = close
        if mid is None or width is None:
            return None, mid, None
        return mid + self.mult * width, mid, mid - self.mult * width


class Sar:
    """Parabolic stop and reverse; a missing bar starts it over.

    Prices are signed by the trend, so that a rising and a falling one share the formulas:
    the stop follows the best price by ``speed`` of the distance, never passes the last two
    bars, and where a bar crosses it the trend turns, with the best price as the new stop.
    """

    def __init__(self, start: float, increment: float, maximum: float):
        self.start, self.increment, self.maximum = start, increment, maximum
        self.stop: Value = None  # signed, as ``best``
        self.sign, self.best, self.speed = 1, 0.0, 0.0
        self.bars: deque = deque(maxlen=2)  # (high, low, close) of the last two

    def _ends(self, high: Value, low: Value) -> tuple[Value, Value]:
        """A bar's signed ends: towards the trend, and towards the stop."""
        ends = (high, low) if self.sign > 0 else (low, high)
        return tuple(None if e is None else self.sign * e for e in ends)

    def push(self, high: Value, low: Value, close: Value) -> Value:
        past = list(self.bars)
        self.bars.append((high, low, close))
        if high is None or low is None or close is None:
            self.stop = None
            return None
        if self.stop is None:
            if not past or past[-1][2] is None:
                return None
            self.sign, self.speed = (1 if close > past[-1][2] else -1), self.start
            self.best, self.stop = self._ends(high, low)[0], self._ends(*past[-1][:2])[1]
            return None if self.stop is None else self.sign * self.stop
        ahead, behind = self._ends(high, low)
        stop = self.stop + self.speed * (self.best - self.stop)
        if stop > behind:
            stop = -max(ahead, self.best)
            self.sign, self.best, self.speed = -self.sign, -behind, self.start
        elif ahead > self.best:
            self.best, self.speed = ahead, min(self.speed + self.increment, self.maximum)
        guards = (self._ends(*b[:2])[1] for b in past)
        self.stop = min([stop, *(g for g in guards if g is not None)])
        return self.sign * self.stop


def _ratchet(band: Value, last: float, close: Value, side: int) -> Value:
    """A lower band (side 1) only rises and an upper one (side -1) only falls, until a close breaks it; ``last``: the band before."""
    if band is None:
        return None
    moves, broken = side * (band - last) > 0, close is not None and side * (close - last) < 0
    return band if moves or broken else last


class Supertrend:
    """Line and direction (-1 up, 1 down): the band on the far side of the trend, until a close crosses it."""

    def __init__(self, factor: float, n: int):
        self.factor, self.atr, self.first, self.warm = factor, Atr(n), True, False
        self.bands: tuple[Value, Value] = (None, None)  # lower, upper
        self.close = self.line = None

    def push(self, high: Value, low: Value, close: Value) -> tuple[Value, Value]:
        atr = self.atr.push(high, low, close)
        known = atr is not None and high is not None and low is not None
        before = [b or 0.0 for b in self.bands]
        raw = [(high + low) / 2 - side * self.factor * atr if known else None for side in (1, -1)]
        lower, upper = (_ratchet(b, last, self.close, side) for b, last, side in zip(raw, before, (1, -1), strict=True))
        direction = 1.0
        if self.warm and not self.first:
            falling = self.line is not None and self.line == before[1]
            band = upper if falling else lower
            crossed = band is not None and close is not None and (close > band if falling else close < band)
            direction = 1.0 if falling != crossed else -1.0
        line = None if upper is None or lower is None else lower if direction < 0 else upper
        if self.first and line is None:
            line = 0.0
        self.first, self.warm, self.bands, self.close, self.line = False, atr is not None, (lower, upper), close, line
        return line, direction


class GapPercentile:
    """Order statistics of the last n bars that keep their order through gaps.

    The window's n places hold its values in order, and among them places for missing bars.
    A missing bar takes the last place. A value takes the place of its rank: before the
    missing places that stand there if it follows a leaving value that is not less,
    else behind them. So with gaps the answer depends on history; without, it is the plain
    percentile. Values are kept sorted, and of each missing place how many stand before it.
    """

    def __init__(self, n: int, percentage: float, linear: bool):
        self.n, self.count = positive(n), 0
        share = min(max(percentage, 0.0), 100.0) / 100.0 * n
        self.at = min(max(share - 0.5, 0.0), n - 1.0) if linear else float(max(math.ceil(share), 1) - 1)
        self.window: deque = deque()
        self.values: list[float] = []
        self.missing: list[list[int]] = []  # [values before it, number of its bar], in order of place

    def _shift(self, rank: int, by: int) -> None:
        """Missing places with ``rank`` values or more before them have ``by`` more."""
        for place in self.missing:
            if place[0] >= rank:
                place[0] += by

    def _at(self, place: int) -> Value:
        gaps = 0
        for k, (before, _) in enumerate(self.missing):
            if before + k == place:
                return None
            gaps += before + k < place
        return self.values[place - gaps]

    def push(self, x: Value) -> Value:
        old = self.window.popleft() if self.count >= self.n else None
        if old is not None:
            rank = bisect_right(self.values, old) - 1
            self.values.pop(rank)
            self._shift(rank + 1, -1)
        else:
            self.missing = [p for p in self.missing if p[1] > self.count - self.n]
        if x is None:
            self.missing.append([len(self.values), self.count])
        else:
            rank = bisect_left(self.values, x)
            self.values.insert(rank, x)
            self._shift(rank if old is not None and x <= old else rank + 1, 1)
        self.window.append(x)
        self.count += 1
        if self.count < self.n:
            return None
        low = int(self.at)
        a, b = self._at(low), self._at(min(low + 1, self.n - 1))
        share = self.at - low
        return a if not share else None if a is None or b is None else a + (b - a) * share


# ---- over bar frames -----------------------------------------------------------------


def scan(bf: BarFrame, inputs: Sequence[Src], out: Sequence[str], make: Callable[[], object]) -> BarFrame:
    """Push each symbol's bars in order through a step of its own. Bars that are dealt by symbol already aren't shuffled again."""
    start = bf
    names = []
    for src in inputs:
        bf, c = bf.bind(src)
        bf = bf.with_columns(**{f"_in{len(names)}": c})
        names.append(f"_in{len(names)}")
    base = [f for f in start.df.schema if f.name not in out]
    schema = StructType([*base, *(StructField(o, DoubleType()) for o in out)])
    n_base, keys = len(base), bf.keys

    def run(batches):
        key, step = None, None
        for batch in batches:
            owners = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            cols = [batch.column(n).to_pylist() for n in names]
            got: list[tuple] = []
            for owner, *values in zip(owners, *cols, strict=True):
                if step is None or owner != key:
                    key, step = owner, make()
                v = step.push(*values)
                got.append(v if isinstance(v, tuple) else (v,))
            made = [pa.array(c, pa.float64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.float64()) for _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_base)] + made, names=schema.fieldNames())

    # a window asks for just the deal and the order that the steps need, and takes those that are there
    rows = bf.df.select(*(f.name for f in base), *names, F.row_number().over(bf.window()).alias("_order"))
    return BarFrame(rows.mapInArrow(run, schema), bf.keys, bf.order)


def ema(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return scan(bf, [src], [out], lambda: Ema(n))


def rma(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return scan(bf, [src], [out], lambda: Rma(n))


def rsi(bf: BarFrame, src: Src = "close", n: int = 14, out: str = "rsi") -> BarFrame:
    return scan(bf, [src], [out], lambda: Rsi(n))


def macd(bf: BarFrame, src: Src = "close", fast: int = 12, slow: int = 26, signal: int = 9, out=("macd", "macd_signal", "macd_hist")) -> BarFrame:
    return scan(bf, [src], out, lambda: Macd(fast, slow, signal))


def tsi(bf: BarFrame, src: Src = "close", short: int = 13, long: int = 25, out: str = "tsi") -> BarFrame:
    return scan(bf, [src], [out], lambda: Tsi(short, long))


def atr(bf: BarFrame, n: int = 14, out: str = "atr") -> BarFrame:
    return scan(bf, ["high", "low", "close"], [out], lambda: Atr(n))


def dmi(bf: BarFrame, n: int = 14, adx: int = 14, out=("plus_di", "minus_di", "adx")) -> BarFrame:
    return scan(bf, ["high", "low", "close"], out, lambda: Dmi(n, adx))


def keltner(bf: BarFrame, n: int = 20, mult: float = 1.5, basis: Src = "close", use_true_range: bool = True, width: str = "ema", out=("kc_up", "kc_mid", "kc_low")) -> BarFrame:
    return scan(bf, ["high", "low", "close", basis], out, lambda: Keltner(n, mult, use_true_range, width))


def sar(bf: BarFrame, start: float = 0.02, increment: float = 0.02, maximum: float = 0.2, out: str = "sar") -> BarFrame:
    return scan(bf, ["high", "low", "close"], [out], lambda: Sar(start, increment, maximum))


def supertrend(bf: BarFrame, factor: float = 3.0, n: int = 10, out=("supertrend", "trend")) -> BarFrame:
    return scan(bf, ["high", "low", "close"], out, lambda: Supertrend(factor, n))


def percentile_through_gaps(bf: BarFrame, src: Src, n: int, percentage: float, out: str, linear: bool = False) -> BarFrame:
    """``ta.percentile_*`` for series with missing bars."""
    return scan(bf, [src], [out], lambda: GapPercentile(n, percentage, linear))


def ema2(bf: BarFrame, src: Src, length: Src, out: str) -> BarFrame:
    return scan(bf, [src, length], [out], lambda: DynamicAverage(True))


def rma2(bf: BarFrame, src: Src, length: Src, out: str) -> BarFrame:
    return scan(bf, [src, length], [out], lambda: DynamicAverage(False))


def atr2(bf: BarFrame, length: Src, out: str) -> BarFrame:
    return scan(bf, ["high", "low", "close", length], [out], DynamicAtr)
