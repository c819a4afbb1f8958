"""Array, map and matrix functions. A matrix is struct<rows int, cols int, data array<double>> by rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- arrays ---------------------------------------------------------------------------


def new(size: int, value=None, kind: str = "double") -> Column:
    return F.array_repeat(F.lit(value).cast(kind), size)


def of(*values: Column) -> Column:
    return F.array(*values)


def size(a: Column) -> Column:
    return F.size(a)


def get(a: Column, i: int) -> Column:
    """From the end if negative; an error outside."""
    return F.element_at(a, i + 1 if i >= 0 else i)


def first(a: Column) -> Column:
    return F.element_at(a, 1)


def last(a: Column) -> Column:
    return F.element_at(a, -1)


def set_at(a: Column, i: int, v: Column) -> Column:
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.transform(a, lambda x, j: F.when(j == at, v).otherwise(x))


def push(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def pop(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def unshift(a: Column, v: Column) -> Column:
    return F.array_prepend(a, v)


def shift(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def insert(a: Column, i: int, v: Column) -> Column:
    return F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0))))


def remove(a: Column, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))


def clear(a: Column, kind: str = "double") -> Column:
    return F.array().cast(f"array<{kind}>")


def includes(a: Column, v: Column) -> Column:
    return F.coalesce(F.array_contains(a, v), F.lit(False))


def indexof(a: Column, v: Column) -> Column:
    return (F.coalesce(F.array_position(a, v), F.lit(0)) - 1).cast("int")


def lastindexof(a: Column, v: Column) -> Column:
    back = F.coalesce(F.array_position(F.reverse(a), v), F.lit(0))
    return F.when(back == 0, -1).otherwise(F.size(a) - back).cast("int")


def cut(a: Column, start: int, end: int | None = None) -> Column:
    return F.slice(a, start + 1, F.greatest((F.size(a) if end is None else F.lit(end)) - start, F.lit(0)))


def fill(a: Column, v: Column, start: int = 0, end: int | None = None) -> Column:
    return F.transform(a, lambda x, j: F.when((j >= start) & (j < end if end is not None else F.lit(True)), v).otherwise(x))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def sort(a: Column, descending: bool = False) -> Column:
    """Missing values last, or first if descending."""
    return F.reverse(F.array_sort(a)) if descending else F.array_sort(a)


def sort_indices(a: Column, descending: bool = False) -> Column:
    """Stable order of places; descending is the ascending one reversed."""
    keyed = F.transform(a, lambda x, j: F.struct(x.isNull().alias("n"), x.alias("v"), j.alias("j")))
    order = F.transform(F.array_sort(keyed), lambda s: s["j"])
    return F.reverse(order) if descending else order


def join(a: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), separator)


def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def total(a: Column) -> Column:
    k = known(a)
    return F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda s, x: s + x))


def avg(a: Column) -> Column:
    return F.try_divide(total(a), F.size(known(a)))


def least(a: Column) -> Column:
    return F.array_min(a)


def greatest(a: Column) -> Column:
    return F.array_max(a)


# ---- maps --------------------------------------------------------------------------------


def map_new(key: str = "string", value: str = "double") -> Column:
    return F.create_map().cast(f"map<{key},{value}>")


def map_put(m: Column, k: Column, v: Column) -> Column:
    """A new key comes last, a known one keeps its place."""
    fresh = F.map_concat(F.map_filter(m, lambda key, _: key != k), F.create_map(k, v))
    return F.when(F.map_contains_key(m, k), F.transform_values(m, lambda key, old: F.when(key == k, v).otherwise(old))).otherwise(fresh)


def map_put_all(m: Column, other: Column) -> Column:
    kept = F.transform_values(m, lambda k, v: F.when(F.map_contains_key(other, k), F.try_element_at(other, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(other, lambda k, _: ~F.map_contains_key(m, k)))


def map_get(m: Column, k: Column, default: Column | None = None) -> Column:
    return F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(default) if default is not None else F.try_element_at(m, k)


def map_contains(m: Column, k: Column) -> Column:
    return F.map_contains_key(m, k)


def map_remove(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda key, _: key != k)


def map_size(m: Column) -> Column:
    return F.size(m)


map_keys, map_values, map_from_entries = F.map_keys, F.map_values, F.map_from_entries

def array_of_objects(size: int = 0, initial: str | None = None) -> Column:
    """An array of drawings, by their identifiers: lines, labels or boxes."""
    return F.array_repeat(F.lit(initial).cast("string"), size)


# ---- matrices --------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is named: lambdas are evaluated again for each cell."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matrix(rows: Column | int, cols: Column | int, data: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(lit(rows).cast("int").alias("rows"), lit(cols).cast("int").alias("cols"), data.alias("data"))


def matrix_new(rows: int, cols: int, value: float | None = None) -> Column:
    return matrix(rows, cols, F.array_repeat(F.lit(value).cast("double"), rows * cols))


def matrix_from_rows(*rows: Column) -> Column:
    """Rows as arrays; all must be as long as the first."""
    same = F.lit(True)
    for r in rows[1:]:
        same = same & (F.size(r) == F.size(rows[0]))
    return F.when(same, matrix(len(rows), F.size(rows[0]), F.concat(*rows))).otherwise(F.raise_error(F.lit("rows differ in length")).cast("struct<rows:int,cols:int,data:array<double>>"))


def matrix_get(m: Column, i: int, j: int) -> Column:
    row = F.lit(i) if i >= 0 else m["rows"] + i
    col = F.lit(j) if j >= 0 else m["cols"] + j
    return F.element_at(m["data"], row * m["cols"] + col + 1)


def matrix_set(m: Column, i: int, j: int, v: Column) -> Column:
    return matrix(m["rows"], m["cols"], F.transform(m["data"], lambda x, k: F.when(k == i * m["cols"] + j, v).otherwise(x)))


def matrix_fill(m: Column, v: Column) -> Column:
    return matrix(m["rows"], m["cols"], F.transform(m["data"], lambda _: v))


def matrix_row(m: Column, i: int) -> Column:
    return F.slice(m["data"], m["cols"] * i + 1, m["cols"])


def matrix_col(m: Column, j: int) -> Column:
    return F.filter(m["data"], lambda x, k: k % m["cols"] == j)


def matrix_count(m: Column) -> Column:
    return m["rows"] * m["cols"]


def transpose(m: Column) -> Column:

    def turned(m: Column) -> Column:
        place = lambda k: (k % m["rows"]) * m["cols"] + F.floor(k / m["rows"]) + 1
        return matrix(m["cols"], m["rows"], F.transform(m["data"], lambda _, k: F.element_at(m["data"], place(k).cast("int"))))

    return _let(m, turned)


def reshape(m: Column, rows: int, cols: int) -> Column:
    return matrix(rows, cols, F.when(F.size(m["data"]) == rows * cols, m["data"]).otherwise(F.raise_error(F.lit("the number of cells differs")).cast("array<double>")))


def matrix_add(m: Column, other: Column | float) -> Column:
    return _cellwise(m, other, lambda x, y: x + y)


def matrix_sub(m: Column, other: Column | float) -> Column:
    return _cellwise(m, other, lambda x, y: x - y)


def _cellwise(m: Column, other, f) -> Column:
    if isinstance(other, Column):
        return matrix(m["rows"], m["cols"], F.zip_with(m["data"], other["data"], f))
    return matrix(m["rows"], m["cols"], F.transform(m["data"], lambda x: f(x, F.lit(float(other)))))


def matrix_scale(m: Column, factor: float) -> Column:
    return _cellwise(m, factor, lambda x, y: x * y)


def matrix_mult(a: Column, b: Column) -> Column:
    """The product; a missing term makes its cell missing."""

    def dot(row: Column, col: Column) -> Column:
        return F.aggregate(F.zip_with(row, col, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def rows_of(m: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), m["rows"] - 1), lambda i: F.slice(m["data"], i * m["cols"] + 1, m["cols"]))
        return F.when(m["rows"] > 0, each).otherwise(F.array().cast("array<array<double>>"))

    def product(p: Column) -> Column:
        x, y = p["a"], p["b"]
        # the columns of b are the rows of its transpose
        cells = _let(rows_of(y), lambda cols: F.flatten(F.transform(rows_of(x), lambda r: F.transform(cols, lambda c: dot(r, c)))))
        return F.when(x["cols"] == y["cols"], matrix(x["rows"], y["rows"], cells)).otherwise(F.raise_error(F.lit("shapes do not fit")).cast("struct<rows:int,cols:int,data:array<double>>"))

    return _let(F.struct(a.alias("a"), transpose(b).alias("b")), product)


def matrix_sum(m: Column) -> Column:
    return total(m["data"])


def matrix_avg(m: Column) -> Column:
    return avg(m["data"])


def matrix_min(m: Column) -> Column:
    return F.array_min(m["data"])


def matrix_max(m: Column) -> Column:
    return F.array_max(m["data"])
