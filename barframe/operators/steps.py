"""Window operators as step classes, for streams: the same values as the windows of ``ta``.

``push`` takes a bar's inputs (``None`` is missing) and returns its outputs. A step keeps the
bars that its window needs and no more. Window and running sums are exact (``math.fsum``), so no
digits are lost, however long the stream or large a level that has left the window; those of
``Vwap``, which begin anew each day, are plain.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from functools import lru_cache

from .frame import positive
from .recursive import Value, true_range
from .ta import LEVELS


def _mean(values) -> float:
    return math.fsum(values) / len(values)


def _deviation(values, spare: int = 0) -> float:
    """Variance with n - ``spare`` as divisor."""
    m = _mean(values)
    return max(math.fsum((v - m) ** 2 for v in values) / (len(values) - spare), 0.0)


# ---- the last n observations ------------------------------------------------------------


class Observed:
    """``of`` the last n observations; repeats at missing bars."""

    def __init__(self, n: int):
        self.values: deque = deque(maxlen=positive(n))
        self.last: Value = None

    def push(self, x: Value) -> Value:
        if x is not None:
            self.values.append(x)
            if len(self.values) == self.values.maxlen:
                self.last = self.of(self.values)
        return self.last

    def of(self, values: deque) -> Value:
        raise TypeError("a subclass says what of")


class Sum(Observed):
    def of(self, values):
        return math.fsum(values)


class Sma(Observed):
    def of(self, values):
        return _mean(values)


class Variance(Observed):
    def __init__(self, n: int, biased: bool = True):
        super().__init__(n)
        self.spare = 0 if biased else 1

    def of(self, values):
        return _deviation(values, self.spare) if len(values) > self.spare else None


class Stdev(Observed):
    def of(self, values):
        return math.sqrt(_deviation(values))


class Bb:
    """Middle, upper, lower."""

    def __init__(self, n: int = 20, mult: float = 2.0):
        self.mult, self.mean, self.dev = mult, Sma(n), Stdev(n)

    def push(self, x: Value) -> tuple[Value, Value, Value]:
        m, d = self.mean.push(x), self.dev.push(x)
        return (None, None, None) if m is None else (m, m + self.mult * d, m - self.mult * d)


class Bbw(Bb):
    def push(self, x: Value) -> Value:
        m, up, low = super().push(x)
        return (up - low) / m if m else None


class Vwma:
    def __init__(self, n: int):
        self.top, self.low = Sum(n), Sum(n)

    def push(self, x: Value, volume: Value) -> Value:
        top, low = self.top.push(None if x is None or volume is None else x * volume), self.low.push(volume)
        return top / low if top is not None and low is not None and low > 0 else None


class _Flow:
    """What rose and what fell, as sums over n."""

    def __init__(self, n: int):
        self.n, self.bars, self.last, self.up, self.down = n, 0, None, Sum(n), Sum(n)

    def _move(self, x: Value) -> Value:
        d = None if x is None or self.last is None else x - self.last
        self.last, self.bars = x, self.bars + 1
        return d


class Cmo(_Flow):
    def push(self, x: Value) -> Value:
        d = self._move(x)
        up, down = self.up.push(d if d is not None and d >= 0 else 0.0), self.down.push(None if d is None else max(-d, 0.0))
        return 100.0 * (up - down) / (up + down) if self.bars > self.n and up is not None and down is not None and up + down else None


class Mfi(_Flow):
    """100 where no negative flow is known, warm-up included."""

    def push(self, x: Value, volume: Value) -> Value:
        d = self._move(x)
        flow = None if x is None or volume is None else x * volume
        up, down = self.up.push(flow if d is not None and d > 0 else 0.0), self.down.push(flow if d is not None and d < 0 else 0.0)
        if not down:
            return 100.0
        return None if up is None else 100.0 - 100.0 / (1.0 + up / down)


# ---- the last n bars ------------------------------------------------------------------------


class Full:
    """``of`` the last n bars, oldest first, where all have a value."""

    def __init__(self, n: int):
        self.bars: deque = deque(maxlen=positive(n))

    def push(self, *x: Value):
        self.bars.append(x[0] if len(x) == 1 else x if None not in x else None)
        return self.of(self.bars) if len(self.bars) == self.bars.maxlen and None not in self.bars else self.none

    none: Value = None

    def of(self, bars: deque):
        raise TypeError("a subclass says what of")


class Weighted(Full):
    """The sum of weights, from the newest bar back, times values."""

    def __init__(self, weights: list[float]):
        super().__init__(len(weights))
        self.weights = list(weights)

    def of(self, bars):
        return math.fsum(w * v for w, v in zip(self.weights, reversed(bars), strict=True))


def Swma() -> Weighted:  # noqa: N802
    return Weighted([1 / 6, 2 / 6, 2 / 6, 1 / 6])


def Alma(n: int, offset: float = 0.85, sigma: float = 6.0) -> Weighted:  # noqa: N802
    raw = [math.exp(-((i - offset * (n - 1)) ** 2) / (2 * (n / sigma) ** 2)) for i in range(n)]
    return Weighted([w / sum(raw) for w in reversed(raw)])


class Wma:
    """Weights n..1 from the newest; gaps carry the last value inside the window but give none themselves."""

    def __init__(self, n: int):
        self.n, self.seen, self.filled = positive(n), 0, deque(maxlen=n)

    def push(self, x: Value) -> Value:
        self.seen += x is not None
        self.filled.append(x if x is not None else self.filled[-1] if self.filled else None)
        if x is None or self.seen < self.n:
            return None
        return math.fsum((k + 1) * v for k, v in enumerate(self.filled)) / (self.n * (self.n + 1) / 2)


class Hma:
    def __init__(self, n: int):
        self.half, self.whole, self.smooth = Wma(max(n // 2, 1)), Wma(n), Wma(max(int(math.sqrt(n)), 1))

    def push(self, x: Value) -> Value:
        h, w = self.half.push(x), self.whole.push(x)
        return self.smooth.push(None if h is None or w is None else 2 * h - w)


class Linreg(Full):
    def __init__(self, n: int, offset: int = 0):
        super().__init__(n)
        self.offset = offset

    def of(self, bars):
        n, centre = len(bars), (len(bars) - 1) / 2
        spread = n * (n * n - 1) / 12
        slope = math.fsum((k - centre) * v for k, v in enumerate(bars)) / spread if n > 1 else 0.0
        return _mean(bars) + slope * (centre - self.offset)


class Correlation:
    """Pearson over n full bars; 0 where a side is constant. Around gaps each moment takes its own n observations."""

    def __init__(self, n: int):
        self.pairs: deque = deque(maxlen=positive(n))
        self.moments = [Sma(n), Sma(n), Sma(n), Stdev(n), Stdev(n)]

    def push(self, x: Value, y: Value) -> Value:
        both = x is not None and y is not None
        self.pairs.append((x, y) if both else None)
        mx, my, mxy, sx, sy = (m.push(v) for m, v in zip(self.moments, (x, y, x * y if both else None, x, y), strict=True))
        if len(self.pairs) == self.pairs.maxlen and None not in self.pairs:
            xs, ys = zip(*self.pairs, strict=True)
            vx, vy = _deviation(xs), _deviation(ys)
            a, b = _mean(xs), _mean(ys)
            return math.fsum((p - a) * (q - b) for p, q in self.pairs) / len(xs) / math.sqrt(vx * vy) if vx and vy else 0.0
        if sx is None or sy is None:
            return None
        return 0.0 if not sx or not sy else None if mxy is None else (mxy - mx * my) / (sx * sy)


class Dev(Full):
    """Mean absolute deviation from the window's mean."""

    def of(self, bars):
        m = _mean(bars)
        return math.fsum(abs(v - m) for v in bars) / len(bars)


class Cci(Dev):
    def of(self, bars):
        spread = super().of(bars)
        return (bars[-1] - _mean(bars)) / (0.015 * spread) if spread else 0.0


class Percentile:
    """Order statistics of n full bars, kept sorted as bars come and go."""

    def __init__(self, n: int, percentage: float, linear: bool = False):
        self.bars: deque = deque(maxlen=positive(n))
        self.sorted: list[float] = []
        share = percentage / 100 * n
        self.at = min(max(share - 0.5, 0.0), n - 1.0) if linear else float(max(math.ceil(share), 1) - 1)

    def push(self, x: Value) -> Value:
        n = self.bars.maxlen
        if len(self.bars) == n and (old := self.bars[0]) is not None:
            self.sorted.pop(bisect_left(self.sorted, old))
        self.bars.append(x)
        if x is not None:
            insort(self.sorted, x)
        if len(self.sorted) < n:
            return None
        low = int(self.at)
        a, b = self.sorted[low], self.sorted[min(low + 1, n - 1)]
        return a + (b - a) * (self.at - low)


# ---- extremes: windows that restart after a gap ------------------------------------------------


class Extreme:
    """The greatest (``sign`` 1) or least (-1) value since the last gap, of n bars at most, and its distance in bars; the earliest of equals.

    Candidates stand in a queue: a bar leaves it when a better one comes, or by age.
    """

    def __init__(self, n: int, sign: int):
        self.n, self.sign, self.index, self.best = positive(n), sign, -1, deque()

    def look(self, x: Value) -> tuple[Value, Value]:
        self.index += 1
        if x is None:
            self.best.clear()
        else:
            while self.best and self.sign * self.best[-1][1] < self.sign * x:
                self.best.pop()
            self.best.append((self.index, x))
            while self.best[0][0] <= self.index - self.n:
                self.best.popleft()
        if self.index < self.n - 1:
            return None, None
        return (None, 0.0) if x is None else (self.best[0][1], float(self.best[0][0] - self.index))

    def push(self, x: Value) -> Value:
        return self.look(x)[0]


class ExtremeBars(Extreme):
    """Bars back (0 or less) to the extreme; 0 at a missing bar."""

    def push(self, x: Value) -> Value:
        return self.look(x)[1]


class Donchian:
    """Upper, middle, lower."""

    def __init__(self, n: int = 20):
        self.high, self.low = Extreme(n, 1), Extreme(n, -1)

    def push(self, high: Value, low: Value) -> tuple[Value, Value, Value]:
        h, lo = self.high.push(high), self.low.push(low)
        return h, None if h is None or lo is None else (h + lo) / 2, lo


class Wpr(Donchian):
    def push(self, high: Value, low: Value, close: Value) -> Value:
        h, _, lo = super().push(high, low)
        if h is None or lo is None or close is None:
            return None
        return -100.0 * (h - close) / (h - lo) if h != lo else 0.0


class Stoch(Donchian):
    """Repeats its last value where the range is zero or something is missing."""

    def __init__(self, n: int = 14):
        super().__init__(n)
        self.last: Value = None

    def push(self, x: Value, high: Value, low: Value) -> Value:
        h, _, lo = super().push(high, low)
        if x is not None and h is not None and lo is not None and h != lo:
            self.last = 100.0 * (x - lo) / (h - lo)
        return self.last


class Pivot:
    """Extremes over ``left`` bars before (ties allowed) and ``right`` after (ties not), told ``right`` bars later; gaps end a side."""

    def __init__(self, left: int, right: int, sign: int):
        self.left, self.right, self.sign, self.index = left, right, sign, -1
        self.bars: deque = deque(maxlen=left + right + 1)

    def push(self, x: Value) -> Value:
        self.index += 1
        self.bars.append(None if x is None else self.sign * x)
        at = len(self.bars) - 1 - self.right
        if at < 0 or self.bars[at] is None or self.index - self.right < self.left:
            return None
        bars, point = list(self.bars), self.bars[at]
        for side, beaten in ((bars[:at][::-1], lambda v: v > point), (bars[at + 1 :], lambda v: v >= point)):
            for v in side:
                if v is None:
                    break
                if beaten(v):
                    return None
        return self.sign * point


# ---- lags and transitions ------------------------------------------------------------------------


class Lag:
    """The value n bars back."""

    def __init__(self, n: int):
        self.bars: deque = deque(maxlen=positive(n) + 1)

    def push(self, x: Value) -> Value:
        self.bars.append(x)
        return self.bars[0] if len(self.bars) == self.bars.maxlen else None


class Change(Lag):
    def push(self, x: Value) -> Value:
        old = super().push(x)
        return None if x is None or old is None else x - old


class Roc(Lag):
    def push(self, x: Value) -> Value:
        old = super().push(x)
        return None if x is None or not old else 100.0 * (x - old) / old


class Cross:
    """1 where the pair crosses since the last complete pair, else 0. ``way``: 1 over, -1 under, 0 either."""

    def __init__(self, way: int = 0):
        self.way, self.last = way, None

    def push(self, x: Value, y: Value) -> float:
        if x is None or y is None:
            return 0.0
        before, now = self.last, (x > y) - (x < y)
        self.last = now
        if before is None or not now or self.way and now != self.way:
            return 0.0
        return float(before != now and (self.way != 0 or before != 0))


class Moving:
    """1 where the last n observed transitions all go one way (``sign``); gaps repeat the answer."""

    def __init__(self, n: int, sign: int):
        self.n, self.sign, self.run, self.seen, self.last, self.value = n, sign, 0, 0, None, 0.0

    def push(self, x: Value) -> float:
        if self.n <= 0:
            return 1.0
        if x is not None:
            moved = self.last is not None and self.sign * (x - self.last) > 0
            self.run = self.run + 1 if moved else 0
            self.last, self.value = x, float(self.run >= self.n)
        return self.value


def _true(c: Value) -> bool:
    return c is not None and c != 0 and math.isfinite(c)


class BarsSince:
    def __init__(self):
        self.index, self.hit = -1, None

    def push(self, cond: Value) -> Value:
        self.index += 1
        self.hit = self.index if _true(cond) else self.hit
        return None if self.hit is None else float(self.index - self.hit)


class ValueWhen:
    """The value at the k-th last true bar; that value may itself be missing."""

    def __init__(self, k: int = 0):
        self.hits: deque = deque(maxlen=k + 1)

    def push(self, cond: Value, x: Value) -> Value:
        if _true(cond):
            self.hits.append(x)
        return self.hits[0] if len(self.hits) == self.hits.maxlen else None


class Cell:
    """A named value of a strategy and what it was at the close of earlier bars."""

    def __init__(self, value: object = None, keep: int = 500):
        self.value, self.past = value, deque(maxlen=keep)

    def commit(self) -> None:
        """The bar closes: its value becomes the first of the past."""
        self.past.append(self.value)

    def ago(self, k: int):
        """The value now (0) or k closed bars back; None before the first."""
        if k < 0:
            raise IndexError("history reaches back zero or more bars")
        return self.value if not k else self.past[-k] if k <= len(self.past) else None

    def push(self, x):
        self.value = x
        self.commit()
        return x


# ---- running and anchored ----------------------------------------------------------------------------


class Cum:
    """The running sum, exact: partial sums that don't overlap."""

    def __init__(self):
        self.parts: list[float] = []

    def push(self, x: Value) -> Value:
        if x is None:
            return None
        kept = []
        for p in self.parts:
            total = x + p
            big, small = (x, p) if abs(x) >= abs(p) else (p, x)
            if rest := small - (total - big):
                kept.append(rest)
            x = total
        self.parts = [*kept, x]
        return math.fsum(self.parts)


class Obv:
    def __init__(self):
        self.last, self.total = None, Cum()

    def push(self, close: Value, volume: Value) -> Value:
        d = None if close is None or self.last is None else close - self.last
        self.last = close
        return self.total.push(None if d is None or volume is None else ((d > 0) - (d < 0)) * volume)


class Accdist:
    def __init__(self):
        self.total = Cum()

    def push(self, high: Value, low: Value, close: Value, volume: Value) -> Value:
        if high is not None and high == low:
            return self.total.push(0.0)
        known = None not in (high, low, close, volume)
        return self.total.push((2 * close - high - low) / (high - low) * volume if known else None)


class Tr:
    def __init__(self, strict: bool = False):
        self.strict, self.last = strict, None

    def push(self, high: Value, low: Value, close: Value) -> Value:
        out = true_range(high, low, self.last, self.strict)
        self.last = close
        return out


class Vwap:
    """Mean price by volume since the last anchor, and bands of ``mult`` deviations. Without ``anchor`` each UTC day is one."""

    def __init__(self, mult: float | None = None):
        self.mult, self.day, self.sums = mult, None, None

    def push(self, time: float, x: Value, volume: Value, anchor: Value = -1.0):
        day = time // 86_400
        if day != self.day if anchor == -1.0 else _true(anchor):
            self.sums = [0.0, 0.0, 0.0]
        self.day = day
        value = width = None
        if self.sums and x is not None and volume is not None:
            self.sums = [s + v for s, v in zip(self.sums, (volume, x * volume, x * x * volume), strict=True)]
            amount, first, second = self.sums
            if amount:
                value = first / amount
                width = math.sqrt(max(second / amount - value * value, 0.0)) * (self.mult or 0.0)
        if self.mult is None:
            return value
        return (None, None, None) if value is None else (value, value + width, value - width)


class Since:
    """The extreme since the last true bar that has a value; before the first, since the start."""

    def __init__(self, sign: int):
        self.sign, self.best = sign, None

    def push(self, cond: Value, x: Value) -> Value:
        if x is not None:
            fresh = _true(cond) or self.best is None
            self.best = x if fresh else max(self.best, x) if self.sign > 0 else min(self.best, x)
        return self.best


class PivotLevels:
    """Eleven levels from the last anchored period, or from the present one so far."""

    def __init__(self, kind: str, developing: bool = False):
        self.kind, self.developing, self.period, self.shown = {"demark": "dm"}.get(kind.lower(), kind.lower()), developing, None, None
        self.anchors = 0
        _formulas(self.kind)

    def push(self, open_: Value, high: Value, low: Value, close: Value, anchor: Value) -> tuple[Value, ...]:
        if _true(anchor):
            self.anchors += 1
            self.shown, self.period = self.period, None
        if self.period is None:
            self.period = {"o": open_, "h": None, "l": None, "c": None, "n": open_}
        p = self.period
        p["h"] = high if p["h"] is None else p["h"] if high is None else max(p["h"], high)
        p["l"] = low if p["l"] is None else p["l"] if low is None else min(p["l"], low)
        p["c"] = p["c"] if close is None else close
        use = p if self.developing else self.shown if self.anchors else None
        if use is None or None in (use["h"], use["l"], use["c"]) or (self.kind == "dm" and use["o"] is None):
            return (None,) * 11
        return _levels(self.kind, use | {"n": p["n"]})


@lru_cache
def _formulas(kind: str) -> list[Callable | None]:
    # the fixed formulas of ta.LEVELS are expressions over single letters
    return [None if s is None else eval(f"lambda o, h, l, c, n, r, q, x, p: {s}") for s in LEVELS[kind]]  # noqa: S307


def _levels(kind: str, v: dict) -> tuple[Value, ...]:
    o, h, low, c, n = (v[k] for k in "ohlcn")
    x = None if o is None else h + low + 2 * c if c == o else 2 * h + low + c if c > o else 2 * low + h + c
    known = {"o": o, "h": h, "l": low, "c": c, "n": n, "r": h - low, "q": h / low if low else None, "x": x, "p": None}
    formulas = _formulas(kind)
    if kind == "woodie" and n is None:
        return (None,) * 11
    known["p"] = formulas[0](**known)
    return tuple(None if f is None else _or_none(f, known) for f in formulas)


def _or_none(f: Callable, known: dict) -> Value:
    try:
        return float(f(**known))
    except TypeError:  # a missing part
        return None
