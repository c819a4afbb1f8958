"""Time alignment of two bar tables: as-of (a higher timeframe on a chart) and bucket (a lower one)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import BarFrame


def step_of(df: DataFrame, keys: Sequence[str], order: str = "time") -> DataFrame:
    """Each key's least positive distance between bars, as ``step``."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, gap.alias("gap")).where("gap > 0").groupBy(*keys).agg(F.min("gap").alias("step"))


def security(chart: BarFrame, requested: BarFrame, values: Sequence[str], chart_step: int, requested_step: int, gaps: bool = False, lookahead: bool = False, prefix: str = "req_") -> BarFrame:
    """``values`` of the requested bars at each chart bar, as ``prefix + name``.

    A requested bar shows once it has closed, ``requested_step - chart_step`` after its
    time, or with ``lookahead`` from its open. With ``gaps`` it shows on the bar of that
    very time only, else until the next one. Take history or averages of the requested
    side before the call: they then count its own bars.

    As-of alignment is one shuffle of both sides by symbol and one running window;
    with gaps it is an equi-join.
    """
    delay = 0 if lookahead else max(requested_step - chart_step, 0)
    keys, order = list(chart.keys), chart.order
    seen = F.col(requested.order) + F.lit(delay)
    bundle = F.struct(*(F.col(v).alias(v) for v in values))
    outs = [prefix + v for v in values]
    if gaps:
        side = requested.df.groupBy(*keys, seen.alias(order)).agg(F.max_by(bundle, F.col(requested.order)).alias("_v"))
        joined = chart.df.join(side, [*keys, order], "left")
        return BarFrame(joined.select(*chart.df.columns, *(F.col("_v")[v].alias(o) for v, o in zip(values, outs, strict=True))), chart.keys, order)
    whole = F.struct(*(F.col(c).alias(c) for c in chart.df.columns))
    left = chart.df.select(*keys, F.col(order).alias("_t"), F.lit(1).alias("_side"), whole.alias("_row"), F.lit(None).cast(requested.df.select(bundle).dtypes[0][1]).alias("_v"))
    right = requested.df.select(*keys, seen.alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(chart.df.select(whole).dtypes[0][1]).alias("_row"), bundle.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    # the struct is never NULL on the requested side, so a missing value there is carried as such
    aligned = left.union(right).withColumn("_v", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)).where("_side = 1")
    return BarFrame(aligned.select("_row.*", *(F.col("_v")[v].alias(o) for v, o in zip(values, outs, strict=True))), chart.keys, order)


def security_lower_tf(chart: BarFrame, lower: BarFrame, values: Sequence[str], chart_step: int, prefix: str = "ltf_", max_size: int | None = None) -> BarFrame:
    """Arrays of the lower bars in [a chart bar's time, the next bar's time), in order; empty ones where there are none.

    The last bucket ends at the bar's close. One shuffle by symbol: each lower bar finds
    its chart bar by a running window, then buckets are summed up.
    """
    keys, order = list(chart.keys), chart.order
    ends = chart.time_closes(chart_step).with_columns(_end=F.coalesce(F.lead(order).over(chart.window()), F.col("time_close"))).df
    marks = ends.select(*keys, F.col(order).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(order).alias("t"), F.col("_end").alias("e")).alias("_bar"), *(F.lit(None).cast(dict(lower.df.dtypes)[v]).alias(v) for v in values))
    inside = lower.df.select(*keys, F.col(lower.order).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("struct<t:bigint,e:bigint>").alias("_bar"), *values)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.union(inside).withColumn("_own", F.last("_bar", ignorenulls=True).over(w)).where("_side = 1 AND _own IS NOT NULL AND _t < _own.e")
    row = F.struct("_t", *values)
    groups = owned.groupBy(*keys, F.col("_own.t").alias(order)).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    out = chart.df.join(groups, [*keys, order], "left")
    for v in values:
        kind = dict(lower.df.dtypes)[v]
        out = out.withColumn(prefix + v, F.coalesce(F.col("_rows")[v], F.array().cast(f"array<{kind}>")))
    if max_size is not None:
        out = out.where(F.assert_true(F.size(prefix + values[0]) <= max_size, F.lit("a lower timeframe group is too large")).isNull())
    return BarFrame(out.drop("_rows"), chart.keys, order)


# ---- groups of lower values ------------------------------------------------------------


def group_size(c: Column) -> Column:
    return F.size(c)


def group_get(c: Column, i: int, default: float | None = None) -> Column:
    """The i-th value, counted from the end if negative."""
    at = F.get(c, F.lit(i)) if i >= 0 else F.try_element_at(c, F.lit(i))
    return F.coalesce(at, F.lit(default))


def group_first(c: Column, default: float | None = None) -> Column:
    return group_get(c, 0, default)


def group_last(c: Column, default: float | None = None) -> Column:
    return group_get(c, -1, default)


def _known(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def group_sum(c: Column, default: float | None = None) -> Column:
    known = _known(c)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(default).cast("double"))


def group_avg(c: Column, default: float | None = None) -> Column:
    return F.coalesce(F.try_divide(group_sum(c), F.size(_known(c))), F.lit(default))


def group_min(c: Column, default: float | None = None) -> Column:
    return F.coalesce(F.array_min(c), F.lit(default))


def group_max(c: Column, default: float | None = None) -> Column:
    return F.coalesce(F.array_max(c), F.lit(default))


def up_down_volume(chart: BarFrame, lower: BarFrame, chart_step: int) -> BarFrame:
    """up_volume, down_volume (negative) and volume_delta from lower bars: a flat one goes with its move from the close before."""
    last = F.lag("close").over(lower.window())
    sign = F.when(F.col("close") != F.col("open"), F.signum(F.col("close") - F.col("open"))).otherwise(F.coalesce(F.signum(F.col("close") - last), F.lit(0.0)))
    signed = lower.with_columns(_signed=sign * F.col("volume"))
    g = security_lower_tf(chart, signed, ["_signed"], chart_step)
    c = F.col("ltf__signed")
    up, down = (F.aggregate(F.filter(c, lambda x: x > 0), F.lit(0.0), lambda s, x: s + x), F.aggregate(F.filter(c, lambda x: x < 0), F.lit(0.0), lambda s, x: s + x))
    return BarFrame(g.df.withColumns({"up_volume": up, "down_volume": down, "volume_delta": up + down}).drop("ltf__signed"), chart.keys, chart.order)


def volume_delta(chart: BarFrame, lower: BarFrame, chart_step: int, anchor: Column) -> BarFrame:
    """Cumulative volume delta as open, high, low, close (cvd_*) since the last true ``anchor``."""
    from .ta import anchored

    last = F.lag("close").over(lower.window())
    sign = F.when(F.col("close") != F.col("open"), F.signum(F.col("close") - F.col("open"))).otherwise(F.coalesce(F.signum(F.col("close") - last), F.lit(0.0)))
    g = security_lower_tf(chart, lower.with_columns(_signed=sign * F.col("volume")), ["_signed"], chart_step)
    walk = F.aggregate("ltf__signed", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("h"), F.lit(0.0).alias("l")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.greatest(a["h"], a["s"] + x).alias("h"), F.least(a["l"], a["s"] + x).alias("l")))
    g = g.with_columns(_walk=walk)
    h, grp = anchored(g, anchor)
    h = h.with_columns(_before=F.coalesce(F.sum("_walk.s").over(h.window(grp).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    b = F.col("_before")
    done = h.with_columns(cvd_open=b, cvd_high=b + F.col("_walk.h"), cvd_low=b + F.col("_walk.l"), cvd_close=b + F.col("_walk.s"))
    return done.keep(chart, "cvd_open", "cvd_high", "cvd_low", "cvd_close")
