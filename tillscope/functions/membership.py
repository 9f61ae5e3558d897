"""A set of keys as a bitmap of fixed size, tested inside another table's scan.

The bitmap is a scalar subquery of the plan, so a filter by it runs before
anything is shuffled. A key that is not in the set may pass by chance, so the
exact semi-join stays behind it; a key of the set always passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a piece (fixed by the bitmap functions), and pieces: 4 MB at most.
PIECE, PIECES = 32_768, 1024


def _place(key: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PIECE * PIECES)) + 1


def key_bitmap(keys: DataFrame, *names: str) -> Column:
    """The set of the keys ``names`` of ``keys``, as a scalar subquery."""
    place = _place([F.col(n) for n in names])
    pieces = keys.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return pieces.agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("bitmap")).scalar()


def may_contain(bitmap: Column, *key: Column) -> Column:
    """Whether ``key`` may be in the set."""
    place = _place(list(key))
    bit = F.bitmap_bit_position(place)
    byte = F.substring(F.try_element_at(bitmap, F.bitmap_bucket_number(place)), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(value, (bit % 8).cast("int")) == 1, F.lit(False))
