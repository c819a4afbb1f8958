"""Output tables: plotted series, candles, markers, levels, fills, colours, signals, and drawing objects with their log.

Each is a tall DataFrame by symbol and time; a report names several of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, SparkSession
from pyspark.sql import functions as F

from .frame import BarFrame, truthy

#: The collections of a report (fixed values).
OUTPUTS = ("lines", "candles", "histograms", "markers", "hlines", "fills", "bgcolors", "labels", "barcolors", "signals", "strategy", "objects", "object_events")


def _text(c: Column | str | None) -> Column:
    return F.lit(c) if c is None or isinstance(c, str) else c


def plot(bf: BarFrame, value: str | Column, name: str, color: Column | str | None = None, show_last: int | None = None, kind: str = "line", offset: int = 0) -> DataFrame:
    """sym, time, name, kind, value, color; ``show_last`` keeps a symbol's last bars, ``offset`` moves points by bars."""
    bf, v = bf.bind(value)
    shifted = v if not offset else F.lag(v, offset).over(bf.window()) if offset > 0 else F.lead(v, -offset).over(bf.window())
    df = bf.df.select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), shifted.alias("value"), _text(color).cast("string").alias("color"))
    return df if show_last is None else _last(df, show_last)


def _last(df: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("time")))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def histogram(bf: BarFrame, value: str | Column, name: str, color: Column | str | None = None) -> DataFrame:
    return plot(bf, value, name, color, kind="histogram")


def candles(bf: BarFrame, open_: str, high: str, low: str, close: str, name: str = "candles", color: Column | str | None = None) -> DataFrame:
    return bf.df.select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), *(F.col(c).cast("double").alias(n) for c, n in ((open_, "open"), (high, "high"), (low, "low"), (close, "close"))), _text(color).cast("string").alias("color"))


def markers(bf: BarFrame, condition: Column, name: str, shape: str = "circle", location: str = "abovebar", text: Column | str = "", color: Column | str | None = None) -> DataFrame:
    """One row a bar whose condition holds."""
    return bf.df.where(truthy(condition)).select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), F.lit(shape).alias("shape"), F.lit(location).alias("location"), _text(text).cast("string").alias("text"), _text(color).cast("string").alias("color"))


def labels(bf: BarFrame, condition: Column, value: str | Column, text: Column | str, name: str = "label") -> DataFrame:
    price = F.col(value) if isinstance(value, str) else value
    return bf.df.where(truthy(condition)).select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), price.cast("double").alias("value"), _text(text).cast("string").alias("text"))


def signals(bf: BarFrame, condition: Column, name: str, message: Column | str = "") -> DataFrame:
    return bf.df.where(truthy(condition)).select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), _text(message).cast("string").alias("message"))


def alert_conditions(bf: BarFrame, **conditions: Column) -> DataFrame:
    """signals of several conditions from one pass over the bars."""
    hits = F.array(*(F.when(truthy(c), F.lit(n)) for n, c in conditions.items()))
    df = bf.df.select("sym", F.col(bf.order).alias("time"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("name"))
    return df.withColumn("message", F.lit(""))


def colors(bf: BarFrame, color: Column, kind: str = "bgcolor") -> DataFrame:
    """bgcolor or barcolor rows, where there is a colour."""
    return bf.df.select("sym", F.col(bf.order).alias("time"), F.lit(kind).alias("kind"), color.cast("string").alias("color")).where("color IS NOT NULL")


def hline(bf: BarFrame, price: float, name: str) -> DataFrame:
    return bf.df.select("sym").distinct().select("sym", F.lit(name).alias("name"), F.lit(float(price)).alias("price"))


def fill(bf: BarFrame, upper: str, lower: str, name: str, color: Column | str | None = None) -> DataFrame:
    return bf.df.select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), F.col(upper).cast("double").alias("upper"), F.col(lower).cast("double").alias("lower"), _text(color).cast("string").alias("color"))


# ---- drawing objects -----------------------------------------------------------------------

OBJECT_EVENTS = "sym string, time long, seq int, id string, op string, kind string, props map<string,string>"


def object_events(bf: BarFrame, *rules: dict) -> DataFrame:
    """The log of drawings. A rule: op ('new', 'set', 'delete'), kind, id (column), when, props (name -> column)."""
    rows = []
    for k, r in enumerate(rules):
        props = F.create_map(*(x for n, v in r.get("props", {}).items() for x in (F.lit(n), _text(v).cast("string")))) if r.get("props") else F.create_map().cast("map<string,string>")
        row = F.struct(F.lit(k).alias("seq"), _text(r["id"]).cast("string").alias("id"), F.lit(r["op"]).alias("op"), F.lit(r.get("kind")).cast("string").alias("kind"), props.alias("props"))
        rows.append(F.when(truthy(r.get("when", F.lit(True))), row))
    return bf.df.select("sym", F.col(bf.order).alias("time"), F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("e")).select("sym", "time", "e.*")


def objects(events: DataFrame, keep_last: int | None = None) -> DataFrame:
    """Living objects from the log: the last value of each property since the object's last 'new'; ``keep_last`` by symbol and kind.

    Properties are settled one by one, with a combine before the shuffle, so an object with many changes is never one row of them.
    """
    at = F.struct("time", "seq")
    new, sets = F.when(F.col("op") == "new", at), F.when(F.col("op").isin("new", "set"), at)
    rows = events.select("sym", "id", "kind", new.alias("new"), sets.alias("at"), F.when(F.col("op") == "delete", at).alias("gone"), F.explode_outer("props").alias("k", "v"))
    per = rows.groupBy("sym", "id", "k").agg(F.max("at").alias("at"), F.max_by("v", "at").alias("v"), F.max("new").alias("new"), F.max_by("kind", "new").alias("kind"), F.max("gone").alias("gone"))
    all_of = F.collect_list(F.when(F.col("k").isNotNull() & F.col("at").isNotNull(), F.struct("k", "v", "at")))  # one entry a property
    each = per.groupBy("sym", "id").agg(F.max("new").alias("born"), F.max_by("kind", "new").alias("kind"), F.max("gone").alias("gone"), all_of.alias("all"))
    live = each.where("born IS NOT NULL AND (gone IS NULL OR gone < born)")
    own = F.transform(F.filter("all", lambda p: p["at"] >= F.col("born")), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    out = live.select("sym", "id", "kind", F.col("born.time").alias("time"), F.when(F.size(own) > 0, F.map_from_entries(F.array_sort(own))).alias("props"))
    if keep_last is None:
        return out
    rank = F.row_number().over(Window.partitionBy("sym", "kind").orderBy(F.desc("time"), F.desc("id")))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= keep_last).drop("_rank")


# ---- reports ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Report:
    """Named output tables; all lazy."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, **tables: DataFrame) -> Report:
        unknown = set(tables) - set(OUTPUTS)
        if unknown:
            raise KeyError(f"no such outputs: {sorted(unknown)}")
        merged = {k: self.tables[k].unionByName(v, allowMissingColumns=True) if k in self.tables else v for k, v in tables.items()}
        return replace(self, tables=self.tables | merged)

    def series_names(self) -> DataFrame:
        return self.tables["lines"].select("name").distinct()

    def series(self, name: str) -> DataFrame:
        return self.tables["lines"].where(F.col("name") == name).select("sym", "time", "value")

    def latest(self, name: str) -> DataFrame:
        """Each symbol's last value that isn't missing."""
        return self.series(name).where("value IS NOT NULL").groupBy("sym").agg(F.max_by("value", "time").alias("value"))

    def to_frame(self, names: Sequence[str]) -> DataFrame:
        """Lines side by side; the names are given, so no pass over the data is needed to learn them."""
        return self.tables["lines"].groupBy("sym", "time").pivot("name", list(names)).agg(F.first("value"))

    def write(self, path: str, kind: str = "parquet") -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: Sequence[str], kind: str = "parquet") -> Report:
        """What ``write`` wrote."""
        return cls().add(**{n: spark.read.format(kind).load(f"{path.rstrip('/')}/{n}") for n in names})

    def to_json(self, name: str) -> DataFrame:
        return self.tables[name].select(F.to_json(F.struct("*")).alias("json"))


# ---- further plots -------------------------------------------------------------------------------


def bar_plot(bf: BarFrame, value: str, name: str, up: str = "#22c55e", down: str = "#ef4444") -> DataFrame:
    """A histogram coloured by its own direction."""
    bf, v = bf.bind(value)
    return plot(bf, v, name, F.when(v >= 0, up).otherwise(down), kind="histogram")


def plot_char(bf: BarFrame, condition: Column, name: str, char: str = "*", location: str = "abovebar", color: Column | str | None = None) -> DataFrame:
    return markers(bf, condition, name, "char", location, char, color)


def plot_arrows(bf: BarFrame, value: str | Column, name: str, low: float = 5.0, high: float = 100.0) -> DataFrame:
    """sym, time, name, direction and height: heights are scaled by a symbol's greatest value."""
    bf, v = bf.bind(value)
    most = F.max(F.abs(v)).over(Window.partitionBy(*bf.keys))
    height = F.lit(low) + F.lit(high - low) * F.try_divide(F.abs(v), most)
    return bf.df.select("sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), F.when(v > 0, "up").otherwise("down").alias("direction"), height.alias("height"), v.alias("value")).where("value IS NOT NULL AND value <> 0")


def emit_signal(bf: BarFrame, condition: Column, name: str, side: str | Column = "", message: str | Column = "", strength: float | Column = 1.0, price: str | Column = "close", payload: Column | None = None) -> DataFrame:
    """Structured signal rows; the payload is a struct or map, kept as JSON."""
    p = F.col(price) if isinstance(price, str) else price
    s = strength if isinstance(strength, Column) else F.lit(float(strength))
    return bf.df.where(truthy(condition)).select(
        "sym", F.col(bf.order).alias("time"), F.lit(name).alias("name"), _text(side).cast("string").alias("side"), _text(message).cast("string").alias("message"), s.alias("strength"), p.cast("double").alias("price"),
        (F.to_json(payload) if payload is not None else F.lit(None).cast("string")).alias("payload"),
    )


def background(bf: BarFrame, condition: Column, color: str) -> DataFrame:
    return colors(bf, F.when(truthy(condition), color), "bgcolor")


def bar_color(bf: BarFrame, color: Column) -> DataFrame:
    return colors(bf, color, "barcolor")
