"""A bitmap of identifiers, of fixed size, that spares most rows a shuffle.

``BITS`` bits in buckets of 32,768 are broadcast: BITS / 8 bytes at most, whatever the
number of identifiers. A row without its bit is surely not among them; a row with it must
still be joined. With many more identifiers than bits every row has its bit, and the
join alone decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import whole_row

BITS = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def _maps(ids: DataFrame, place: Column) -> DataFrame:
    """(bucket, bits) of the places (1 to BITS) of ``ids``: BITS / 32,768 rows at most."""
    return ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def hash_bits(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes as BITS / 8 bytes on the driver: hash h has bit h % BITS."""
    out = np.zeros((BITS // 32_768, 4096), np.uint8)
    for bucket, bits in _maps(hashes, F.pmod(F.col(hashes.columns[0]), F.lit(BITS)) + 1).collect():
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether hashes (unsigned) have their bit; false: surely not among those."""
    place = hashes & np.uint64(BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def may_be_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(row: the columns of ``rows`` as a struct, hit): ``hit`` is false where ``key`` is surely not in ``ids`` (one column)."""
    maps = _maps(ids, _place(F.col(ids.columns[0])))
    place = _place(F.col(key))
    found = rows.select(whole_row(rows).alias("row"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).join(F.broadcast(maps), "bucket", "left")
    bit = F.expr("(cast(conv(hex(substring(bits, cast(at div 8 + 1 AS int), 1)), 16, 10) AS int) >> cast(at % 8 AS int)) & 1")
    return found.select("row", F.coalesce(bit == 1, F.lit(False)).alias("hit"))
