"""BarFrame: ordered bars by symbol, and the window shapes that operators are made of."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Src = str | Column
_number = count()


def positive(n: int, name: str = "period") -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{name} must be a positive integer")
    return n


@dataclass(frozen=True)
class BarFrame:
    """A DataFrame of bars, partitioned by ``keys`` and ordered by ``order``.

    Operators return a new frame with one or more columns added; all windows hash by
    ``keys``, so a chain of them shares one exchange. A missing value is NULL.
    """

    df: DataFrame
    keys: tuple[str, ...] = ("sym",)
    order: str = "time"

    # ---- shapes -----------------------------------------------------------------

    def window(self, *more: Column) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(self.order)

    def so_far(self, *more: Column) -> WindowSpec:
        return self.window(*more).rowsBetween(Window.unboundedPreceding, 0)

    def last_rows(self, n: int, *more: Column) -> WindowSpec:
        return self.window(*more).rowsBetween(-(n - 1), 0)

    def together(self) -> BarFrame:
        """Bars dealt by symbol once: windows by symbol and finer ones then need no other exchange."""
        return replace(self, df=self.df.repartition(*self.keys))

    # ---- columns ----------------------------------------------------------------

    def with_columns(self, **columns: Column) -> BarFrame:
        return replace(self, df=self.df.withColumns(columns))

    def bind(self, src: Src, kind: str = "double") -> tuple[BarFrame, Column]:
        """(frame, column reference) of a source that may hold windows of its own."""
        if isinstance(src, str) and src in self.df.columns and dict(self.df.dtypes)[src] == kind:
            return self, F.col(src)
        name = f"_b{next(_number)}"
        value = F.col(src) if isinstance(src, str) else src
        return self.with_columns(**{name: value.cast(kind)}), F.col(name)

    def keep(self, like: BarFrame, *more: str) -> BarFrame:
        """Only the columns of ``like`` and ``more``."""
        return replace(self, df=self.df.select(*(c for c in like.df.columns if c not in more), *more))

    def add(self, out: str | Sequence[str], step: Callable[[BarFrame], tuple[BarFrame, Column | Sequence[Column]]]) -> BarFrame:
        """Run ``step`` on this frame and keep its result as ``out``, without its intermediates."""
        bf, value = step(self)
        names, values = ([out], [value]) if isinstance(out, str) else (list(out), list(value))
        return bf.with_columns(**dict(zip(names, values, strict=True))).keep(self, *names)

    # ---- bars --------------------------------------------------------------------

    def index(self) -> Column:
        """0 for a symbol's first bar."""
        return (F.row_number().over(self.window()) - 1).cast("long")

    def history(self, src: Src, k: int, out: str) -> BarFrame:
        """The value ``k`` bars back."""
        if isinstance(k, bool) or not isinstance(k, int) or k < 0:
            raise IndexError("history reaches back zero or more bars")
        return self.add(out, lambda bf: ((x := bf.bind(src, self._kind(src)))[0], F.lag(x[1], k).over(self.window()) if k else x[1]))

    def _kind(self, src: Src) -> str:
        return dict(self.df.dtypes).get(src, "double") if isinstance(src, str) else self.df.select(src).dtypes[0][1]

    def sources(self) -> BarFrame:
        """hl2, hlc3, ohlc4, hlcc4."""
        o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
        return self.with_columns(hl2=(h + low) / 2, hlc3=(h + low + c) / 3, ohlc4=(o + h + low + c) / 4, hlcc4=(h + low + c + c) / 4)

    def bar_state(self) -> BarFrame:
        """bar_index, last_bar_index, isfirst, islast."""
        every = Window.partitionBy(*self.keys)
        bf = self.with_columns(bar_index=self.index())
        return bf.with_columns(last_bar_index=F.max("bar_index").over(every)).with_columns(isfirst=F.col("bar_index") == 0, islast=F.col("bar_index") == F.col("last_bar_index"))

    def time_closes(self, seconds: int | None = None) -> BarFrame:
        """time_close: given, else the next bar's time, else time plus the timeframe or the symbol's least step."""
        nxt = F.lead(self.order).over(self.window())
        bf = self.with_columns(_next=nxt)
        step = F.lit(seconds) if seconds is not None else F.min(F.col("_next") - F.col(self.order)).over(Window.partitionBy(*self.keys))
        given = [F.col("time_close")] if "time_close" in self.df.columns else []
        return bf.with_columns(time_close=F.coalesce(*given, "_next", F.col(self.order) + step)).keep(self, "time_close")


# ---- missing values and conditions ------------------------------------------------


def truthy(c: Column, kind: str = "boolean") -> Column:
    """True for true, and for finite numbers but 0; missing is false."""
    return F.coalesce(c if kind == "boolean" else (c != 0) & (F.abs(c) != float("inf")) & ~F.isnan(c), F.lit(False))


def gt(a: Column, b: Column | float) -> Column:
    return F.coalesce(a > b, F.lit(False))


def ge(a: Column, b: Column | float) -> Column:
    return F.coalesce(a >= b, F.lit(False))


def lt(a: Column, b: Column | float) -> Column:
    return F.coalesce(a < b, F.lit(False))


def le(a: Column, b: Column | float) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def eq(a: Column, b: Column | float) -> Column:
    return F.coalesce(a == b, F.lit(False))


def ne(a: Column, b: Column | float) -> Column:
    return F.coalesce(a != b, F.lit(True))


def divide(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a, b)


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * F.floor(F.try_divide(a, b))


def switch(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first true condition."""
    if not cases:
        return default if isinstance(default, Column) else F.lit(default)
    out = None
    for cond, value in cases:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def nz(x: Column, replacement: Column | float = 0.0) -> Column:
    return F.coalesce(x, replacement if isinstance(replacement, Column) else F.lit(replacement))


def na(x: Column) -> Column:
    return x.isNull()


def fixnan(bf: BarFrame, src: Src, out: str) -> BarFrame:
    """Missing values repeat the last one."""
    return bf.add(out, lambda f: ((x := f.bind(src))[0], F.last(x[1], ignorenulls=True).over(f.so_far())))


def state_series(bf: BarFrame, updates: Src, out: str, default: float | None = None) -> BarFrame:
    """A state variable: NULL updates keep the last value; ``default`` before the first."""
    return bf.add(out, lambda f: ((x := f.bind(updates))[0], F.coalesce(F.last(x[1], ignorenulls=True).over(f.so_far()), F.lit(default).cast("double"))))
