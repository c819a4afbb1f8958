"""Technical-analysis operators that window functions express.

Each takes a BarFrame and returns it with ``out`` added. Missing bars differ by family:
averages and moments work on the last n *observations* and repeat across gaps; extremes
restart at a gap; weighted operators need n full bars.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .frame import BarFrame, Src, divide, positive, truthy

# ---- observation windows -----------------------------------------------------------


def observed(bf: BarFrame, src: Src, n: int, agg: Callable[[Column], Column]) -> tuple[BarFrame, Column]:
    """``agg`` over the last n observations; repeats at missing bars; NULL before the n-th."""
    positive(n)
    bf, x = bf.bind(src)
    w = bf.last_rows(n, x.isNotNull())
    bf, v = bf.bind(F.when(x.isNotNull() & (F.count(x).over(w) == n), agg(x).over(w)))
    return bf, F.last(v, ignorenulls=True).over(bf.so_far())


def rolling_sum(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: observed(f, src, n, F.sum))


def sma(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: observed(f, src, n, F.avg))


def volume_sma(bf: BarFrame, n: int = 20, out: str = "volume_sma") -> BarFrame:
    return sma(bf, "volume", n, out)


def stdev(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: observed(f, src, n, F.stddev_pop))


def variance(bf: BarFrame, src: Src, n: int, out: str, biased: bool = True) -> BarFrame:
    if not biased and n == 1:
        return bf.add(out, lambda f: (f, F.lit(None).cast("double")))
    return bf.add(out, lambda f: observed(f, src, n, F.var_pop if biased else F.var_samp))


def bb(bf: BarFrame, src: Src, n: int = 20, mult: float = 2.0, out: tuple[str, str, str] = ("bb_mid", "bb_up", "bb_low")) -> BarFrame:
    """Middle, upper, lower."""

    def step(f):
        f, x = f.bind(src)
        f, mid = _bound(f, lambda g: observed(g, x, n, F.avg))
        f, dev = _bound(f, lambda g: observed(g, x, n, F.stddev_pop))
        return f, (mid, mid + mult * dev, mid - mult * dev)

    return bf.add(out, step)


def _bound(bf: BarFrame, step) -> tuple[BarFrame, Column]:
    """Run a step and bind its result to a column of its own."""
    return (lambda r: r[0].bind(r[1]))(step(bf))


def bbw(bf: BarFrame, src: Src, n: int = 20, mult: float = 2.0, out: str = "bbw") -> BarFrame:
    def step(f):
        g = bb(f, src, n, mult, ("_m", "_u", "_l"))
        return g, divide(F.col("_u") - F.col("_l"), F.col("_m"))

    return bf.add(out, step)


def vwma(bf: BarFrame, src: Src, n: int, out: str, volume: Src = "volume") -> BarFrame:
    def step(f):
        f, x = f.bind(src)
        f, v = f.bind(volume)
        f, top = _bound(f, lambda g: observed(g, x * v, n, F.sum))
        f, low = _bound(f, lambda g: observed(g, v, n, F.sum))
        return f, F.when(low > 0, top / low)

    return bf.add(out, step)


def cmo(bf: BarFrame, src: Src, n: int = 14, out: str = "cmo") -> BarFrame:
    def step(f):
        f, d = _delta(f, src)
        f, up = _bound(f, lambda g: observed(g, F.when(d >= 0, d).otherwise(0.0), n, F.sum))
        f, down = _bound(f, lambda g: observed(g, F.when(d >= 0, 0.0).otherwise(-d), n, F.sum))
        return f, F.when(f.index() >= n, divide(100.0 * (up - down), up + down))

    return bf.add(out, step)


def mfi(bf: BarFrame, src: Src = "hlc3", n: int = 14, out: str = "mfi", volume: Src = "volume") -> BarFrame:
    """100 where no negative flow is known, warm-up included."""

    def step(f):
        f, x = f.bind(_typical(f, src))
        f, v = f.bind(volume)
        f, d = _delta(f, x)
        flow = x * v
        f, up = _bound(f, lambda g: observed(g, F.when(d > 0, flow).otherwise(0.0), n, F.sum))
        f, down = _bound(f, lambda g: observed(g, F.when(d < 0, flow).otherwise(0.0), n, F.sum))
        return f, F.when(down.isNull() | (down == 0), 100.0).otherwise(100.0 - 100.0 / (1.0 + up / down))

    return bf.add(out, step)


def _typical(bf: BarFrame, src: Src) -> Src:
    if isinstance(src, str) and src not in bf.df.columns and src == "hlc3":
        return (F.col("high") + F.col("low") + F.col("close")) / 3
    return src


def _delta(bf: BarFrame, src: Src, n: int = 1) -> tuple[BarFrame, Column]:
    bf, x = bf.bind(src)
    return bf.bind(x - F.lag(x, n).over(bf.window()))


# ---- full windows --------------------------------------------------------------------


def _full(bf: BarFrame, src: Src, n: int) -> tuple[BarFrame, Column, Column]:
    """(frame, x, whether the last n bars are all there)"""
    positive(n)
    bf, x = bf.bind(src)
    bf, ready = bf.bind(F.count(x).over(bf.last_rows(n)) == n, "boolean")
    return bf, x, ready


def _weighted(bf: BarFrame, x: Column, weights: list[float]) -> tuple[BarFrame, Column]:
    """Sum of weights[i] * x[i bars back] over one frame, whatever its length; NULL unless all bars are there."""
    n = len(weights)
    oldest_first = F.lit([float(c) for c in reversed(weights)])
    bf, values = bf.bind(F.when(F.count(x).over(bf.last_rows(n)) == n, _window_array(bf, x, n)), "array<double>")
    return bf, F.aggregate(F.zip_with(values, oldest_first, lambda v, c: v * c), F.lit(0.0), lambda s, v: s + v)


def swma(bf: BarFrame, src: Src, out: str) -> BarFrame:
    return bf.add(out, lambda f: (lambda g, c: (g, c / 6.0))(*_weighted(*f.bind(src), [1, 2, 2, 1])))


def wma(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    """Weights n..1 from the newest; gaps carry the last value inside the window but give NULL themselves."""
    positive(n)

    def step(f):
        f, x = f.bind(src)
        f, filled = f.bind(F.last(x, ignorenulls=True).over(f.so_far()))
        f, total = _bound(f, lambda g: _weighted(g, filled, list(range(n, 0, -1))))
        ready = x.isNotNull() & (F.count(x).over(f.so_far()) >= n)
        return f, F.when(ready, total / (n * (n + 1) / 2))

    return bf.add(out, step)


def hma(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    def step(f):
        f, x = f.bind(src)
        g = wma(wma(f, x, max(n // 2, 1), "_h"), x, n, "_w")
        g = wma(g, 2 * F.col("_h") - F.col("_w"), max(int(math.sqrt(n)), 1), "_o")
        return g, F.col("_o")

    return bf.add(out, step)


def alma(bf: BarFrame, src: Src, n: int, out: str, offset: float = 0.85, sigma: float = 6.0) -> BarFrame:
    """Gaussian weights, the peak at ``offset`` of the window; the newest bar is its end."""
    positive(n)
    peak, width = offset * (n - 1), n / sigma
    raw = [math.exp(-((i - peak) ** 2) / (2 * width * width)) for i in range(n)]
    weights = [w / sum(raw) for w in reversed(raw)]
    return bf.add(out, lambda f: _weighted(*f.bind(src), weights))


def linreg(bf: BarFrame, src: Src, n: int, out: str, offset: int = 0) -> BarFrame:
    """Least-squares line over n bars, its value ``offset`` bars back."""

    def step(f):
        f, x, ready = _full(f, src, n)
        f, i = f.bind(f.index())
        rows = f.last_rows(n)
        if n == 1:
            return f, F.when(ready, x)
        slope, mean = F.regr_slope(x, i).over(rows), F.avg(x).over(rows)
        return f, F.when(ready, mean + slope * ((n - 1) / 2 - offset))

    return bf.add(out, step)


def correlation(bf: BarFrame, a: Src, b: Src, n: int, out: str) -> BarFrame:
    """Pearson over n full bars; 0 where a side is constant. Around gaps each moment takes its own n observations."""
    positive(n)

    def step(f):
        f, x = f.bind(a)
        f, y = f.bind(b)
        rows = f.last_rows(n)
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        f, whole = f.bind(F.count(both).over(rows) == n, "boolean")
        # not corr, which divides by zero in constant windows
        spread = F.sqrt(F.var_pop(x).over(rows) * F.var_pop(y).over(rows))
        f, direct = f.bind(F.when(whole, F.when(spread == 0, 0.0).otherwise(F.try_divide(F.covar_pop(x, y).over(rows), spread))))
        f, mx = _bound(f, lambda g: observed(g, x, n, F.avg))
        f, my = _bound(f, lambda g: observed(g, y, n, F.avg))
        f, mxy = _bound(f, lambda g: observed(g, x * y, n, F.avg))
        f, sx = _bound(f, lambda g: observed(g, x, n, F.stddev_pop))
        f, sy = _bound(f, lambda g: observed(g, y, n, F.stddev_pop))
        apart = F.when((sx == 0) | (sy == 0), 0.0).otherwise((mxy - mx * my) / (sx * sy))
        return f, F.when(whole, direct).otherwise(apart)

    return bf.add(out, step)


def _window_array(bf: BarFrame, x: Column, n: int) -> Column:
    return F.collect_list(x).over(bf.last_rows(n))


def dev(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    """Mean absolute deviation from the window's mean."""

    def step(f):
        f, x, ready = _full(f, src, n)
        f, values = f.bind(_window_array(f, x, n), "array<double>")
        f, mean = f.bind(F.avg(x).over(f.last_rows(n)))
        return f, F.when(ready, F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n)

    return bf.add(out, step)


def cci(bf: BarFrame, src: Src = "hlc3", n: int = 20, out: str = "cci") -> BarFrame:
    def step(f):
        f, x, ready = _full(f, _typical(f, src), n)
        f, mean = f.bind(F.avg(x).over(f.last_rows(n)))
        f, values = f.bind(_window_array(f, x, n), "array<double>")
        mad = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n
        f, mad = f.bind(mad)
        return f, F.when(ready, F.when(mad == 0, 0.0).otherwise((x - mean) / (0.015 * mad)))

    return bf.add(out, step)


def percentile_nearest_rank(bf: BarFrame, src: Src, n: int, percentage: float, out: str) -> BarFrame:
    rank = max(math.ceil(percentage / 100 * n), 1)

    def step(f):
        f, x, ready = _full(f, src, n)
        f, values = f.bind(F.array_sort(_window_array(f, x, n)), "array<double>")
        return f, F.when(ready, F.get(values, F.lit(rank - 1)))

    return bf.add(out, step)


def percentile_linear_interpolation(bf: BarFrame, src: Src, n: int, percentage: float, out: str) -> BarFrame:
    """Between the ranks around p / 100 * n - 1/2, clipped to the ends."""
    at = min(max(percentage / 100 * n - 0.5, 0.0), n - 1.0)
    low, share = int(at), at - int(at)

    def step(f):
        f, x, ready = _full(f, src, n)
        f, values = f.bind(F.array_sort(_window_array(f, x, n)), "array<double>")
        a, b = F.get(values, F.lit(low)), F.get(values, F.lit(min(low + 1, n - 1)))
        return f, F.when(ready, a + (b - a) * share)

    return bf.add(out, step)


# ---- extremes: windows that restart after a gap -------------------------------------------


def _run(bf: BarFrame, x: Column) -> tuple[BarFrame, Column]:
    """A number that grows at every missing bar."""
    return bf.bind(F.sum(x.isNull().cast("long")).over(bf.so_far()), "bigint")


def _extreme(bf: BarFrame, src: Src, n: int, agg: Callable[[Column], Column]) -> tuple[BarFrame, Column]:
    positive(n)
    bf, x = bf.bind(src)
    bf, seg = _run(bf, x)
    return bf, F.when(x.isNotNull() & (bf.index() >= n - 1), agg(x).over(bf.last_rows(n, seg)))


def highest(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _extreme(f, src, n, F.max))


def lowest(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _extreme(f, src, n, F.min))


def _extreme_bars(bf: BarFrame, src: Src, n: int, high: bool) -> tuple[BarFrame, Column]:
    """Bars back (0 or less) to the extreme, the earliest of equals; 0 at a missing bar."""
    positive(n)
    bf, x = bf.bind(src)
    bf, seg = _run(bf, x)
    bf, i = bf.bind(bf.index(), "bigint")
    key = F.when(x.isNotNull(), F.struct(x.alias("x"), (-i if high else i).alias("i")))
    best = (F.max if high else F.min)(key).over(bf.last_rows(n, seg))["i"]
    return bf, F.when(i >= n - 1, F.when(x.isNull(), 0.0).otherwise((F.abs(best) - i).cast("double")))


def highestbars(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _extreme_bars(f, src, n, True))


def lowestbars(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _extreme_bars(f, src, n, False))


def donchian(bf: BarFrame, n: int = 20, out: tuple[str, str, str] = ("don_up", "don_mid", "don_low"), high: Src = "high", low: Src = "low") -> BarFrame:
    """Upper, middle, lower."""

    def step(f):
        f, h = _bound(f, lambda g: _extreme(g, high, n, F.max))
        f, low_ = _bound(f, lambda g: _extreme(g, low, n, F.min))
        return f, (h, (h + low_) / 2, low_)

    return bf.add(out, step)


def _range(f: BarFrame, high: Src, low: Src, n: int):
    f, h = _bound(f, lambda g: _extreme(g, high, n, F.max))
    f, low_ = _bound(f, lambda g: _extreme(g, low, n, F.min))
    return f, h, low_


def wpr(bf: BarFrame, n: int = 14, out: str = "wpr", high: Src = "high", low: Src = "low", close: Src = "close") -> BarFrame:
    def step(f):
        f, h, low_ = _range(f, high, low, n)
        f, c = f.bind(close)
        return f, F.when(h == low_, F.when(c.isNotNull(), 0.0)).otherwise(-100.0 * (h - c) / (h - low_))

    return bf.add(out, step)


def stoch(bf: BarFrame, src: Src = "close", n: int = 14, out: str = "stoch", high: Src = "high", low: Src = "low") -> BarFrame:
    """Repeats its last value where the range is zero or something is missing."""

    def step(f):
        f, h, low_ = _range(f, high, low, n)
        f, x = f.bind(src)
        f, raw = f.bind(divide(100.0 * (x - low_), h - low_))
        return f, F.last(raw, ignorenulls=True).over(f.so_far())

    return bf.add(out, step)


# ---- lags, transitions -----------------------------------------------------------------------


def change(bf: BarFrame, src: Src, n: int = 1, out: str = "change") -> BarFrame:
    positive(n)
    return bf.add(out, lambda f: _delta(f, src, n))


mom = change


def roc(bf: BarFrame, src: Src, n: int = 1, out: str = "roc") -> BarFrame:
    positive(n)

    def step(f):
        f, x = f.bind(src)
        f, old = f.bind(F.lag(x, n).over(f.window()))
        return f, divide(100.0 * (x - old), old)

    return bf.add(out, step)


def _pairs(bf: BarFrame, a: Src, b: Src | float, test: Callable[[Column, Column, Column, Column], Column]) -> tuple[BarFrame, Column]:
    """``test`` of a bar's pair and of the last complete pair before it; false where a side is missing."""
    bf, x = bf.bind(a)
    bf, y = bf.bind(F.lit(float(b)) if isinstance(b, int | float) else b)
    there = x.isNotNull() & y.isNotNull()
    w = bf.window(there)
    return bf, F.coalesce(there & test(F.lag(x).over(w), F.lag(y).over(w), x, y), F.lit(False))


def crossover(bf: BarFrame, a: Src, b: Src | float, out: str) -> BarFrame:
    return bf.add(out, lambda f: _pairs(f, a, b, lambda p, q, x, y: (p <= q) & (x > y)))


def crossunder(bf: BarFrame, a: Src, b: Src | float, out: str) -> BarFrame:
    return bf.add(out, lambda f: _pairs(f, a, b, lambda p, q, x, y: (p >= q) & (x < y)))


def cross(bf: BarFrame, a: Src, b: Src | float, out: str) -> BarFrame:
    return bf.add(out, lambda f: _pairs(f, a, b, lambda p, q, x, y: ((p < q) & (x > y)) | ((p > q) & (x < y))))


def _moving(bf: BarFrame, src: Src, n: int, up: bool) -> tuple[BarFrame, Column]:
    """Whether the last n observed transitions all go one way; gaps repeat the answer."""
    if n <= 0:
        return bf, F.lit(True)
    bf, x = bf.bind(src)
    before = F.lag(x).over(bf.window(x.isNotNull()))
    bf, step = bf.bind(F.when(x.isNotNull(), F.coalesce((x > before if up else x < before).cast("int"), F.lit(0))), "int")
    w = bf.last_rows(n, x.isNotNull())
    bf, all_ = bf.bind(F.when(x.isNotNull(), (F.min(step).over(w) == 1) & (F.count(step).over(w) == n)), "boolean")
    return bf, F.coalesce(F.last(all_, ignorenulls=True).over(bf.so_far()), F.lit(False))


def rising(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _moving(f, src, n, True))


def falling(bf: BarFrame, src: Src, n: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _moving(f, src, n, False))


def barssince(bf: BarFrame, cond: Column, out: str) -> BarFrame:
    def step(f):
        f, c = f.bind(truthy(cond), "boolean")
        f, i = f.bind(f.index(), "bigint")
        return f, i - F.last(F.when(c, i), ignorenulls=True).over(f.so_far())

    return bf.add(out, step)


def valuewhen(bf: BarFrame, cond: Column, src: Src, k: int, out: str) -> BarFrame:
    """``src`` at the k-th last true bar; that value may itself be missing."""

    def step(f):
        f, c = f.bind(truthy(cond), "boolean")
        f, x = f.bind(src)
        w = f.window(c)
        enough = F.row_number().over(w) > k
        f, hit = f.bind(F.when(c & enough, F.struct(F.lag(x, k).over(w).alias("v") if k else x.alias("v"))), "struct<v:double>")
        return f, F.last(hit, ignorenulls=True).over(f.so_far())["v"]

    return bf.add(out, step)


def _pivot(bf: BarFrame, src: Src, left: int, right: int, high: bool) -> tuple[BarFrame, Column]:
    """Extremes over ``left`` bars before (ties allowed) and ``right`` after (ties not), told ``right`` bars later."""
    bf, x = bf.bind(src)
    seg = F.sum(x.isNull().cast("long")).over(bf.so_far())
    bf, seg = bf.bind(seg, "bigint")
    bf, i = bf.bind(bf.index(), "bigint")
    w = bf.window(seg, x.isNull())
    agg = F.max if high else F.min
    before = agg(x).over(w.rowsBetween(-left, -1)) if left else F.lit(None).cast("double")
    after = agg(x).over(w.rowsBetween(1, right)) if right else F.lit(None).cast("double")
    good = F.coalesce(x >= before if high else x <= before, F.lit(True)) & F.coalesce(x > after if high else x < after, F.lit(True))
    bf, point = bf.bind(F.when(x.isNotNull() & (i >= left) & good, x))
    return bf, F.lag(point, right).over(bf.window()) if right else point


def pivothigh(bf: BarFrame, src: Src, left: int, right: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _pivot(f, src, left, right, True))


def pivotlow(bf: BarFrame, src: Src, left: int, right: int, out: str) -> BarFrame:
    return bf.add(out, lambda f: _pivot(f, src, left, right, False))


# ---- running and anchored ---------------------------------------------------------------------


def cum(bf: BarFrame, src: Src, out: str) -> BarFrame:
    return bf.add(out, lambda f: (lambda g, x: (g, F.when(x.isNotNull(), F.sum(x).over(g.so_far()))))(*f.bind(src)))


def obv(bf: BarFrame, out: str = "obv", close: Src = "close", volume: Src = "volume") -> BarFrame:
    def step(f):
        f, d = _delta(f, close)
        f, v = f.bind(volume)
        f, flow = f.bind(F.signum(d) * v)
        return f, F.when(flow.isNotNull(), F.sum(flow).over(f.so_far()))

    return bf.add(out, step)


def accdist(bf: BarFrame, out: str = "accdist") -> BarFrame:
    h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    return cum(bf, F.when(h == low, 0.0).otherwise((2 * c - h - low) / (h - low) * v), out)


def tr(bf: BarFrame, out: str = "tr", high: Src = "high", low: Src = "low", close: Src = "close", strict: bool = False) -> BarFrame:
    """True range; without a close before it high - low, or NULL if ``strict``."""

    def step(f):
        f, h = f.bind(high)
        f, low_ = f.bind(low)
        f, c = f.bind(close)
        f, old = f.bind(F.lag(c).over(f.window()))
        full = F.greatest(h - low_, F.abs(h - old), F.abs(low_ - old))
        whole = h.isNotNull() & low_.isNotNull()
        return f, F.when(whole & old.isNotNull(), full) if strict else F.when(whole, F.when(old.isNull(), h - low_).otherwise(full))

    return bf.add(out, step)


def anchored(bf: BarFrame, anchor: Column) -> tuple[BarFrame, Column]:
    """The number of anchors so far: 0 before the first."""
    bf, a = bf.bind(truthy(anchor), "boolean")
    return bf.bind(F.sum(a.cast("long")).over(bf.so_far()), "bigint")


def new_day(bf: BarFrame) -> Column:
    """A symbol's first bar, and the first of each UTC day."""
    day = F.floor(F.col(bf.order) / 86_400)
    return F.coalesce(day != F.floor(F.lag(bf.order).over(bf.window()) / 86_400), F.lit(True))


def vwap(bf: BarFrame, src: Src = "hlc3", anchor: Column | None = None, mult: float | None = None, out: str | tuple[str, str, str] = "vwap", volume: Src = "volume") -> BarFrame:
    """Mean price by volume since the last anchor (default: each day); with ``mult`` also bands of that many deviations."""

    def step(f):
        f, x = f.bind(_typical(f, src))
        f, v = f.bind(volume)
        f, grp = anchored(f, new_day(f) if anchor is None else anchor)
        w = f.so_far(grp)
        good = x.isNotNull() & v.isNotNull() & (grp > 0)
        amount = F.sum(F.when(good, v)).over(w)
        f, value = f.bind(F.when(good, divide(F.sum(F.when(good, x * v)).over(w), amount)))
        if mult is None:
            return f, value
        var = F.greatest(divide(F.sum(F.when(good, x * x * v)).over(w), amount) - value * value, F.lit(0.0))
        f, width = f.bind(F.when(value.isNotNull(), F.sqrt(var) * mult))
        return f, (value, value + width, value - width)

    return bf.add(out, step)


def _since(bf: BarFrame, cond: Column, src: Src, agg: Callable[[Column], Column]) -> tuple[BarFrame, Column]:
    """The extreme since the last true bar that has a value; before the first, since the start."""
    bf, x = bf.bind(src)
    bf, grp = anchored(bf, cond & x.isNotNull())
    return bf, agg(x).over(bf.so_far(grp))


def highest_since(bf: BarFrame, cond: Column, out: str, src: Src = "high") -> BarFrame:
    return bf.add(out, lambda f: _since(f, cond, src, F.max))


def lowest_since(bf: BarFrame, cond: Column, out: str, src: Src = "low") -> BarFrame:
    return bf.add(out, lambda f: _since(f, cond, src, F.min))


#: Levels P, R1, S1, ... R5, S5 of each family, in terms of the last period's o, h, l, c, its
#: range r and quotient q = h / l, the present open n and the pivot p; None: not defined (fixed values).
LEVELS = {
    "traditional": ("(h+l+c)/3", "2*p-l", "2*p-h", "p+r", "p-r", "2*p+h-2*l", "2*p-(2*h-l)", "3*p+h-3*l", "3*p-(3*h-l)", "4*p+h-4*l", "4*p-(4*h-l)"),
    "fibonacci": ("(h+l+c)/3", "p+0.382*r", "p-0.382*r", "p+0.618*r", "p-0.618*r", "p+r", "p-r", None, None, None, None),
    "woodie": ("(h+l+2*n)/4", "2*p-l", "2*p-h", "p+r", "p-r", "h+2*(p-l)", "l-2*(h-p)", "h+2*(p-l)+r", "l-2*(h-p)-r", None, None),
    "classic": ("(h+l+c)/3", "2*p-l", "2*p-h", "p+r", "p-r", "p+2*r", "p-2*r", "p+3*r", "p-3*r", None, None),
    "dm": ("x/4", "x/2-l", "x/2-h", None, None, None, None, None, None, None, None),
    "camarilla": ("(h+l+c)/3", "c+r*1.1/12", "c-r*1.1/12", "c+r*1.1/6", "c-r*1.1/6", "c+r*1.1/4", "c-r*1.1/4", "c+r*1.1/2", "c-r*1.1/2", "q*c", "c-(q*c-c)"),
}


def pivot_point_levels(bf: BarFrame, kind: str, anchor: Column, out: str, developing: bool = False) -> BarFrame:
    """Eleven levels from the last anchored period, or from the present one so far."""
    formulas = LEVELS[{"demark": "dm"}.get(kind.lower(), kind.lower())]
    parts = "struct<o:double,h:double,l:double,c:double>"

    def step(f):
        f, grp = anchored(f, anchor)
        here = f.so_far(grp)
        now = F.struct(F.first("open").over(here).alias("o"), F.max("high").over(here).alias("h"), F.min("low").over(here).alias("l"), F.last("close", ignorenulls=True).over(here).alias("c"))
        f, period = f.bind(now, parts)
        f, first = f.bind(F.row_number().over(f.window(grp)) == 1, "boolean")
        started = grp > 0
        if not developing:
            f, before = f.bind(F.when(first & started, F.lag(period).over(f.window())), parts)
            f, period = f.bind(F.last(before, ignorenulls=True).over(f.so_far()), parts)
        f = f.with_columns(_n=F.first("open").over(here), **{f"_{k}": period[k] for k in "ohlc"})
        f = f.with_columns(_r=F.col("_h") - F.col("_l"), _q=F.try_divide("_h", "_l"))
        f = f.with_columns(_x=F.expr("CASE WHEN _c = _o THEN _h + _l + 2 * _c WHEN _c > _o THEN 2 * _h + _l + _c ELSE 2 * _l + _h + _c END"))
        named = lambda s: "".join(f"_{c}" if c.isalpha() else c for c in s)
        f = f.with_columns(_p=F.expr(named(formulas[0])).cast("double"))
        levels = [F.expr(named(s)).cast("double") if s else F.lit(None).cast("double") for s in formulas]
        return f, F.when(F.col("_p").isNotNull() & (F.lit(True) if developing else started), F.array(*levels))

    return bf.add(out, step)


def change_percent(new: Column, old: Column) -> Column:
    return divide(100.0 * (new - old), old)


def cagr(entry_time: Column, entry_price: Column, exit_time: Column, exit_price: Column, now: Column) -> Column:
    """Yearly growth in percent over a day or more, once ``now`` has reached the exit; times beyond 1e10 are milliseconds."""
    ms = F.greatest(F.abs(entry_time), F.abs(exit_time)) > 10_000_000_000
    scale = F.when(ms, 1000.0).otherwise(1.0)
    seconds = (exit_time - entry_time) / scale
    clock = F.when(F.abs(now) > 10_000_000_000, now / 1000.0).otherwise(now.cast("double"))
    years = seconds / (365.0 * 86_400.0)
    return F.when((seconds >= 86_400.0) & (entry_price > 0) & (exit_price > 0) & (clock >= exit_time / scale), 100 * (F.pow(exit_price / entry_price, 1 / years) - 1))
