"""Time, timeframe and session functions over epoch seconds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
_UNITS = {"T": 1, "S": 1, "": 60, "D": DAY, "W": 7 * DAY, "M": 30 * DAY}


@dataclass(frozen=True)
class Timeframe:
    """``5`` minutes, ``30S``, ``1D``, ``2W``, ``3M``; a bare letter means one."""

    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Timeframe:
        m = re.fullmatch(r"(\d*)([TSDWM]?)", text.strip().upper())
        if not m or not m[0] or m[1] and int(m[1]) < 1:
            raise ValueError(f"no timeframe: {text!r}")
        return cls(int(m[1] or 1), m[2])

    def seconds(self) -> int:
        return self.count * _UNITS[self.unit]

    @classmethod
    def from_seconds(cls, seconds: int) -> Timeframe:
        """The coarsest unit that divides the seconds; under a minute in seconds."""
        for unit in ("W", "D", ""):
            if seconds >= _UNITS[unit] and seconds % _UNITS[unit] == 0:
                return cls(seconds // _UNITS[unit], unit)
        return cls(seconds, "S")

    def __str__(self) -> str:
        return f"{self.count}{self.unit}"


def local(t: Column, zone: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(t), zone)


def year(t: Column, zone: str = "UTC") -> Column:
    return F.year(local(t, zone))


def month(t: Column, zone: str = "UTC") -> Column:
    return F.month(local(t, zone))


def dayofmonth(t: Column, zone: str = "UTC") -> Column:
    return F.dayofmonth(local(t, zone))


def dayofweek(t: Column, zone: str = "UTC") -> Column:
    """Sunday is 1."""
    return F.dayofweek(local(t, zone))


def hour(t: Column, zone: str = "UTC") -> Column:
    return F.hour(local(t, zone))


def minute(t: Column, zone: str = "UTC") -> Column:
    return F.minute(local(t, zone))


def second(t: Column, zone: str = "UTC") -> Column:
    return F.second(local(t, zone))


def timestamp(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None, s: Column | None = None, zone: str = "UTC") -> Column:
    zero = F.lit(0)
    parts = [y, mo, d, zero if h is None else h, zero if mi is None else mi, zero if s is None else s]
    return F.unix_timestamp(F.to_utc_timestamp(F.make_timestamp_ntz(*parts).cast("timestamp"), zone))


def time_format(t: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    return F.date_format(local(t, zone), pattern)


def bucket(t: Column, timeframe: str, zone: str = "UTC") -> Column:
    """A number that changes with each timeframe bar: weeks begin on Mondays, days count from the first of year 1, months from January of year 0."""
    tf = Timeframe.parse(timeframe)
    at = local(t, zone)
    if tf.unit == "M":
        return F.floor((F.year(at) * 12 + F.month(at) - 1) / tf.count)
    days = F.datediff(F.to_date(at), F.to_date(F.lit("0001-01-01"))).cast("long")
    if tf.unit == "W":
        return F.floor(F.floor(days / 7) / tf.count)
    if tf.unit == "D":
        return F.floor(days / tf.count)
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.floor((days * DAY + seconds) / tf.seconds())


def bar_open(t: Column, timeframe: str, zone: str = "UTC") -> Column:
    """The opening time of the timeframe bar around ``t``."""
    tf = Timeframe.parse(timeframe)
    b = bucket(t, timeframe, zone) * tf.count
    first = F.to_date(F.lit("0001-01-01"))
    if tf.unit == "M":
        at = F.make_date(F.floor(b / 12).cast("int"), (b % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")
    elif tf.unit in ("W", "D"):
        at = F.date_add(first, (b * (7 if tf.unit == "W" else 1)).cast("int")).cast("timestamp")
    else:
        whole = bucket(t, timeframe, zone) * tf.seconds()
        at = F.timestamp_seconds(F.unix_timestamp(F.date_add(first, F.floor(whole / DAY).cast("int")).cast("timestamp")) + whole % DAY)
    return F.unix_timestamp(F.to_utc_timestamp(at, zone))


def changed(bf, timeframe: str, zone: str = "UTC") -> Column:
    """True on a symbol's first bar and on the first of each timeframe bar. Needs the bucket as a column: ``bf`` gets ``_bucket``."""
    return F.coalesce(F.col("_bucket") != F.lag("_bucket").over(bf.window()), F.lit(True))


def timeframe_change(bf, timeframe: str, out: str, zone: str = "UTC"):
    g = bf.with_columns(_bucket=bucket(F.col(bf.order), timeframe, zone))
    return g.with_columns(**{out: changed(g, timeframe, zone)}).keep(bf, out)


def in_session(t: Column, session: str, zone: str = "UTC") -> Column:
    """Whether ``t`` lies in ``HHMM-HHMM[,HHMM-HHMM][:days]`` (days 1 to 7 from Sunday) or ``24x7``; a night's hours after midnight belong to the day they began for."""
    if session.strip().lower() == "24x7":
        return t.isNotNull()
    spans, _, days = session.partition(":")
    at = local(t, zone)
    now, day = F.hour(at) * 60 + F.minute(at), F.dayofweek(at)
    allowed = {int(c) for c in days} or set(range(1, 8))
    fits = F.lit(False)
    for span in spans.split(","):
        a, b = (int(x[:2]) * 60 + int(x[2:]) for x in span.strip().split("-"))
        if a < b:
            fits = fits | ((now >= a) & (now < b) & day.isin(*allowed))
        else:  # over night: the evening counts for the next day
            evening = {(d - 2) % 7 + 1 for d in allowed}
            fits = fits | ((now >= a) & day.isin(*evening)) | ((now < b) & day.isin(*allowed))
    return F.coalesce(fits, F.lit(False))


def time(t: Column, timeframe: str, session: str | None = None, zone: str = "UTC") -> Column:
    """Opening time of the timeframe bar; NULL outside the session."""
    opened = bar_open(t, timeframe, zone)
    return opened if session is None else F.when(in_session(t, session, zone), opened)
