"""Scalar functions: mathematics, strings, colours and ticker identifiers, as column expressions. Missing is NULL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- mathematics ---------------------------------------------------------------------


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def m_abs(x: Column) -> Column:
    return F.abs(x)


def m_log(x: Column) -> Column:
    """NULL at 0 and below."""
    return F.when(x > 0, F.ln(x))


def m_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def m_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def m_exp(x: Column) -> Column:
    return F.exp(x)


def m_pow(base: Column, exponent: Column | float) -> Column:
    return _finite(F.pow(base, exponent))


def m_ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def m_floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def m_round(x: Column, places: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, places)


def m_trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _all_known(args: tuple[Column, ...], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (x.isNotNull() for x in args)), value)


def m_max(*args: Column) -> Column:
    """NULL if any argument is."""
    return args[0] if len(args) == 1 else _all_known(args, F.greatest(*args))


def m_min(*args: Column) -> Column:
    return args[0] if len(args) == 1 else _all_known(args, F.least(*args))


def m_avg(*args: Column) -> Column:
    return reduce(lambda a, b: a + b, args) / len(args)


def m_sign(x: Column) -> Column:
    return F.signum(x)


def round_to_mintick(x: Column, tick: float) -> Column:
    return F.round(F.floor(x / tick + 0.5) * tick, 10)


def m_random(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    """Uniform; a seed fixes it for a given partitioning."""
    return low + (high - low) * (F.rand(seed) if seed is not None else F.rand())


m_sin, m_cos, m_tan, m_atan, to_degrees, to_radians = F.sin, F.cos, F.tan, F.atan, F.degrees, F.radians


def m_asin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def m_acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


# ---- strings ---------------------------------------------------------------------------


def tostring(x: Column, kind: str = "double", fmt: str | None = None) -> Column:
    """Text of a value: ``na`` if missing, lower-case booleans, numbers without idle zeros.

    ``fmt``: like ``#.##`` (at most so many places), ``0.00`` (just so many), ``percent``, ``integer``.
    """
    if kind != "double":
        text = F.lower(x.cast("string")) if kind == "boolean" else x.cast("string")
        return F.coalesce(text, F.lit("na"))
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = lambda c, n: F.replace(F.format_number(F.bround(c, n), n), F.lit(","), F.lit(""))
    if fmt is None:
        text = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    elif fmt == "integer":
        text = F.bround(x, 0).cast("long").cast("string")
    elif fmt == "percent":
        text = F.concat(trim(fixed(x * 100, 2)), F.lit("%"))
    else:
        places = len(fmt.partition(".")[2])
        text = fixed(x, places) if "0" in fmt.partition(".")[2] else trim(fixed(x, places)) if places else F.bround(x, 0).cast("long").cast("string")
    return F.coalesce(text, F.lit("na"))


def tonumber(s: Column) -> Column:
    return _finite(s.try_cast("double"))


def s_length(s: Column) -> Column:
    return F.length(s)


def s_substring(s: Column, begin: int, end: int | None = None) -> Column:
    """[begin, end), counted from 0, clipped to the text."""
    return F.substring(s, max(begin, 0) + 1, 2**31 - 1 if end is None else max(end - max(begin, 0), 0))


def s_pos(s: Column, part: str) -> Column:
    """The first place of ``part``, or -1."""
    return F.instr(s, part) - 1


def s_contains(s: Column, part: str) -> Column:
    return F.coalesce(F.contains(s, F.lit(part)), F.lit(False))


def s_match(s: Column, pattern: str) -> Column:
    """The first match, or NULL."""
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, 0))


def s_startswith(s: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(s, F.lit(prefix)), F.lit(False))


def s_endswith(s: Column, suffix: str) -> Column:
    return F.coalesce(F.endswith(s, F.lit(suffix)), F.lit(False))


def s_replace(s: Column, target: str, replacement: str, occurrence: int = 0) -> Column:
    """Replaces one occurrence, counted from 0."""
    before = F.substring_index(s, target, occurrence + 1)
    found = F.length(before) < F.length(s)
    rest = F.substr(s, F.length(before) + len(target) + 1)
    return F.when(found, F.concat(before, F.lit(replacement), rest)).otherwise(s)


def s_replace_all(s: Column, target: str, replacement: str) -> Column:
    return F.replace(s, F.lit(target), F.lit(replacement))


def s_split(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator))


def s_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


s_upper, s_lower = F.upper, F.lower


def s_repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def s_format(template: str, *args: Column) -> Column:
    """``{}`` and ``{0}`` stand for arguments."""
    parts, next_ = [], iter(range(len(args)))
    for literal, hole in re.findall(r"([^{]*)(\{\d*\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if hole:
            parts.append(args[int(hole[1:-1]) if hole != "{}" else next(next_)])
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("na")) for p in parts)) if parts else F.lit("")


# ---- colours -----------------------------------------------------------------------------


def rgb(r: Column, g: Column, b: Column, transparency: Column | float = 0) -> Column:
    """``#rrggbb``, or ``rgba(r,g,b,a)`` where transparency (0 to 100) is over 0."""
    t = transparency if isinstance(transparency, Column) else F.lit(float(transparency))
    alpha = F.bround(1 - t / 100, 2)
    as_int = [c.cast("int") for c in (r, g, b)]
    return F.when(t > 0, F.format_string("rgba(%d,%d,%d,%s)", *as_int, tostring(alpha))).otherwise(F.format_string("#%02x%02x%02x", *as_int))


def _channel(c: Column, k: int) -> Column:
    hexed = F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10)
    listed = F.regexp_extract(c, r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", k + 1)
    return F.when(F.startswith(c, F.lit("#")), hexed).otherwise(listed).cast("double")


def red(c: Column) -> Column:
    return _channel(c, 0)


def green(c: Column) -> Column:
    return _channel(c, 1)


def blue(c: Column) -> Column:
    return _channel(c, 2)


def transparency(c: Column) -> Column:
    a = F.regexp_extract(c, r"rgba\([^,]+,[^,]+,[^,]+,\s*([0-9.]+)\)", 1)
    return F.when(a != "", F.bround((1 - a.try_cast("double")) * 100, 6)).otherwise(0.0)


def new_color(base: Column, t: Column | float) -> Column:
    return rgb(red(base), green(base), blue(base), t)


def color_when(condition: Column, yes: Column | str, no: Column | str) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.when(F.coalesce(condition, F.lit(False)), lit(yes)).otherwise(lit(no))


def from_gradient(value: Column, low: Column | float, high: Column | float, low_color: str, high_color: str) -> Column:
    """The colour between two hex colours at the value's share of the range, clipped."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo + 1e-10)))
    ends = [(int(low_color[i : i + 2], 16), int(high_color[i : i + 2], 16)) for i in (1, 3, 5)]
    return F.when(value.isNotNull(), F.format_string("#%02x%02x%02x", *((a + share * (b - a)).cast("int") for a, b in ends)))


# ---- ticker identifiers ---------------------------------------------------------------------


def ticker_new(prefix: str | None, ticker: str, **modifiers: str | None) -> str:
    """``PREFIX:TICKER?key=value&...``; a name that has its prefix keeps it."""
    name = ticker if not prefix or ":" in ticker else f"{prefix}:{ticker}"
    query = "&".join(f"{k}={v}" for k, v in modifiers.items() if v is not None)
    return f"{name}?{query}" if query else name


def ticker_standard(tickerid: str) -> str:
    return tickerid.partition("?")[0]


def ticker_modify(tickerid: str, **modifiers: str | None) -> str:
    name, _, query = tickerid.partition("?")
    old = dict(p.split("=", 1) for p in query.split("&") if "=" in p)
    return ticker_new(None, name, **(old | {k: v for k, v in modifiers.items() if v is not None}))


def ticker_inherit(chart: str, ticker: str, **modifiers: str | None) -> str:
    prefix = chart.partition("?")[0].rpartition(":")[0]
    return ticker_new(prefix or None, ticker, **modifiers)


def ticker_heikinashi(tickerid: str) -> str:
    return ticker_modify(tickerid, chart="heikinashi")


def ticker_renko(tickerid: str, style: str | None = None, param: float | None = None) -> str:
    return ticker_modify(tickerid, chart="renko", style=style, param=None if param is None else str(param))


def ticker_linebreak(tickerid: str, lines: int | None = None) -> str:
    return ticker_modify(tickerid, chart="linebreak", lines=None if lines is None else str(lines))


def ticker_kagi(tickerid: str, reversal: float | None = None) -> str:
    return ticker_modify(tickerid, chart="kagi", reversal=None if reversal is None else str(reversal))


def ticker_pointfigure(tickerid: str, style: str | None = None, param: float | None = None, reversal: int | None = None) -> str:
    return ticker_modify(tickerid, chart="pointfigure", style=style, param=None if param is None else str(param), reversal=None if reversal is None else str(reversal))
