"""Joins of many rows with a table of one row a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task reads, at least; at most HUBS keys have more than their part.
FAN, HUBS = 256, 100_000


def hubs(sizes: DataFrame, key: str, total: int) -> DataFrame | None:
    """(hub, parts) of the keys with very many rows, to be broadcast; None without any. ``sizes``: key, size.

    HUBS rows at most, as no more keys can have over a HUBS-th of the ``total`` rows.
    """
    fan = max(FAN, total // HUBS)
    rows = sizes.where(F.col("size") > fan).select(F.col(key).alias("hub"), F.expr(f"int(size div {fan} + 1)").alias("parts")).collect()
    return F.broadcast(sizes.sparkSession.createDataFrame(rows, f"hub {dict(sizes.dtypes)[key]}, parts int")) if rows else None


def in_part(rows: DataFrame, key: str, by: str, heavy: DataFrame | None, name: str = "part") -> DataFrame:
    """``rows`` with the part of their key that ``by`` deals them to."""
    if heavy is None:
        return rows.withColumn(name, F.lit(0))
    dealt = rows.join(heavy, F.col(key) == F.col("hub"), "left")
    return dealt.withColumn(name, F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("hub", "parts")


def in_all_parts(facts: DataFrame, key: str, heavy: DataFrame | None, name: str = "part") -> DataFrame:
    """A row of ``facts`` for each part of its key."""
    if heavy is None:
        return facts.withColumn(name, F.lit(0))
    sent = facts.join(heavy, F.col(key) == F.col("hub"), "left")
    return sent.withColumn(name, F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("hub", "parts")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, sizes: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts`` (a row a ``key``); rows of a key with very many are dealt in parts by ``by``.

    ``sizes``: (key, size) of the keys of ``rows``; ``total``: their number. Neither side has columns hub, parts, part.
    """
    heavy = hubs(sizes, key, total)
    return in_part(rows, key, by, heavy).join(in_all_parts(facts, key, heavy), [key, "part"], how).drop("part")
