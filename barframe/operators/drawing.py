"""Drawing objects: typed rules for the log of ``output.object_events``.

A rule says when, on which bars, an object is made, changed or deleted. The properties
of each kind are fixed values; a setter of any of them, alone or several at once, is one rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties of each kind of object (fixed values).
PROPERTIES = {
    "line": ("x1", "y1", "x2", "y2", "color", "width", "style", "extend", "xloc"),
    "linefill": ("line1", "line2", "color"),
    "polyline": ("points", "curved", "closed", "line_color", "fill_color", "line_style", "line_width"),
    "label": ("x", "y", "text", "color", "textcolor", "style", "size", "xloc", "yloc", "tooltip"),
    "box": ("left", "top", "right", "bottom", "bgcolor", "border_color", "border_width", "border_style", "extend", "text", "text_color", "text_size", "text_halign", "text_valign"),
    "table": ("position", "columns", "rows", "bgcolor", "frame_color", "border_color"),
}
#: Setters that stand for two properties, in the order of their arguments.
PAIRS = {"xy1": ("x1", "y1"), "xy2": ("x2", "y2"), "xy": ("x", "y"), "lefttop": ("left", "top"), "rightbottom": ("right", "bottom")}


@dataclass(frozen=True)
class Point:
    """A place on the chart: by bar index or by time, and a price."""

    price: Column
    index: Column | None = None
    time: Column | None = None

    @property
    def x(self) -> Column:
        return self.index if self.index is not None else self.time


def _checked(kind: str, props: dict) -> dict:
    known = PROPERTIES[kind]
    wrong = [p for p in props if p not in known and not (kind == "table" and p.startswith("cell_"))]
    if wrong:
        raise KeyError(f"{kind} has no {', '.join(wrong)}")
    return {k: v if isinstance(v, Column) else F.lit(v) for k, v in props.items()}


def new(kind: str, id: Column | str, when: Column | None = None, **props) -> dict:
    return {"op": "new", "kind": kind, "id": id, "when": F.lit(True) if when is None else when, "props": _checked(kind, props)}


def set_props(kind: str, id: Column | str, when: Column | None = None, **props) -> dict:
    return {"op": "set", "kind": kind, "id": id, "when": F.lit(True) if when is None else when, "props": _checked(kind, props)}


def set_pair(kind: str, id: Column | str, pair: str, x: Column, y: Column, when: Column | None = None) -> dict:
    a, b = PAIRS[pair]
    return set_props(kind, id, when, **{a: x, b: y})


def set_point(kind: str, id: Column | str, pair: str, point: Point, when: Column | None = None) -> dict:
    return set_pair(kind, id, pair, point.x, point.price, when)


def delete(id: Column | str, when: Column | None = None) -> dict:
    return {"op": "delete", "id": id, "when": F.lit(True) if when is None else when}


def cell(id: Column | str, column: int, row: int, text: Column | str, when: Column | None = None) -> dict:
    return set_props("table", id, when, **{f"cell_{column}_{row}": text})


def clear_cells(id: Column | str, columns: range, rows: range, when: Column | None = None) -> dict:
    return set_props("table", id, when, **{f"cell_{c}_{r}": "" for c in columns for r in rows})


def merge_cells(id: Column | str, start: tuple[int, int], end: tuple[int, int], when: Column | None = None) -> dict:
    """The first cell covers the range."""
    return set_props("table", id, when, **{f"cell_{start[0]}_{start[1]}_merged_to": f"{end[0]},{end[1]}"})


def copied(objects: DataFrame, suffix: str) -> DataFrame:
    """Copies of living objects under new identifiers."""
    return objects.withColumn("id", F.concat("id", F.lit(suffix)))


def value_of(objects: DataFrame, prop: str) -> DataFrame:
    """sym, id and one property of living objects, as a number where it is one."""
    text = F.col("props")[prop]
    return objects.select("sym", "id", text.alias(prop), text.try_cast("double").alias(f"{prop}_number"))


def without_orphans(objects: DataFrame) -> DataFrame:
    """Drops line fills whose lines are gone."""
    lines = objects.where("kind = 'line'").select("sym", F.col("id").alias("line"))
    fills = objects.where("kind = 'linefill'")
    for k in ("line1", "line2"):
        fills = fills.withColumn("_l", F.col("props")[k]).join(lines.withColumnRenamed("sym", "_s"), F.expr("sym = _s AND _l = line"), "left_semi").drop("_l")
    return objects.where("kind <> 'linefill'").unionByName(fills)
