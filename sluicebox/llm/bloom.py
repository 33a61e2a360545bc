"""Bloom filters as tables of bitmaps, and joins that move only the rows that pass one. [native]

No filter that is sent to all executors has more than MAX_BITS / 8 bytes. One that is too small for its keys lets more
rows through, which costs their move and never changes a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import fresh, park
from sluicebox.storage import drop, park_by

BITMAP = 32768


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> int:
    bits = BITMAP
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def _positions(hash_col: Column, bits: int) -> list[Column]:
    return [F.pmod(hash_col, F.lit(bits)), F.pmod(F.xxhash64(hash_col, F.lit(7)), F.lit(bits))]


def position_pair(hash_col: Column, bits: int) -> Column:
    return F.array(*[p.cast("long") for p in _positions(hash_col, bits)])


def _set_in(bitmap: Column, position: Column) -> Column:
    """Whether the bit of a position is set; false without a bitmap."""
    bit = F.pmod(position, F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shifted = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int"))
    return F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))


def _bitmaps(positions: DataFrame) -> DataFrame:
    """(bucket, bitmap) of distinct positions p."""
    return positions.groupBy(F.floor(F.col("p") / BITMAP).cast("long").alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.pmod(F.col("p"), F.lit(BITMAP))).alias("bitmap"))


#: Most bits of a filter that is sent to all executors at once, and bits for each row.
MAX_BITS, BITS_PER_ROW = 1 << 28, 32


def _first(hash_col: Column, bits: int) -> Column:
    return F.pmod(hash_col, F.lit(bits)).cast("long")


def possibly_repeated(rows: DataFrame, hash_col: str, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """rows, which are read several times and so best parked, with `maybe`: true for every row whose hash another row
    has too, and for few others."""
    n = rows.count()
    ranges = -(-n * bits_per_row // max_bits)
    if ranges < 2:
        return _tested(rows, hash_col, filter_bits(n, bits_per_row, max_bits))[0]
    name = fresh(rows, "_range")[0]
    dealt = park_by(rows.withColumn(name, F.pmod(F.xxhash64(F.lit(11), hash_col), F.lit(ranges)).cast("int")), name, "ranges")
    parts = []
    for k in range(ranges):
        tested, maps = _tested(dealt.filter(F.col(name) == k).drop(name), hash_col, max_bits)
        parts.append(park(tested, "tested"))
        drop(maps)
    return reduce(DataFrame.unionByName, parts)


def _tested(rows: DataFrame, hash_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    twice = rows.select(_first(F.col(hash_col), bits).alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
    maps = park(_bitmaps(twice), "filter")
    bucket, bitmap = fresh(rows, "_bucket", "_bitmap")
    # At most bits / 8 bytes.
    side = F.broadcast(maps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    position = _first(F.col(hash_col), bits)
    out = rows.join(side, F.floor(position / BITMAP).cast("long") == F.col(bucket), "left")
    return out.withColumn("maybe", _set_in(F.col(bitmap), position)).drop(bucket, bitmap), maps


def filter_of(hashes: DataFrame, hash_col: str, bits: int) -> DataFrame:
    """(bucket, bitmap) of the positions of all hashes."""
    return _bitmaps(hashes.select(F.explode(position_pair(F.col(hash_col), bits)).alias("p")))


def probed(rows: DataFrame, hash_col: Column, maps: DataFrame, bits: int, name: str = "maybe") -> DataFrame:
    """rows with `name`: whether the filter holds both positions of the hash. The bitmaps have bits / 8 bytes at
    most, so this broadcast is bounded whatever the input."""
    bucket, bitmap, one, two = fresh(rows, "_bucket", "_bitmap", "_one", "_two")
    side = F.broadcast(maps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    for hit, position in zip((one, two), _positions(hash_col, bits)):
        rows = rows.join(side, F.floor(position / BITMAP).cast("long") == F.col(bucket), "left").withColumn(hit, _set_in(F.col(bitmap), position)).drop(bucket, bitmap)
    return rows.withColumn(name, F.col(one) & F.col(two)).drop(one, two)


def _sieved(rows: DataFrame, keys: DataFrame, here: dict[str, Column], name: str) -> DataFrame:
    hashed = park(keys.select(F.xxhash64(*here).alias("h")), "keys")
    bits = filter_bits(hashed.count(), 16, MAX_BITS)
    maps = park(filter_of(hashed, "h", bits), "filter")
    digest = fresh(rows, "_digest")[0]
    return probed(rows.withColumn(digest, F.xxhash64(*here.values())), F.col(digest), maps, bits, name).drop(digest)


def _same(here: dict[str, Column]) -> Column:
    return reduce(Column.__and__, [c.eqNullSafe(F.col(k)) for k, c in here.items()])


def apart(rows: DataFrame, keys: DataFrame, here: dict[str, Column], most: int) -> DataFrame:
    """The rows that no key names; here gives for each column of keys what it is of a row. Up to `most` keys are
    broadcast; beyond that only rows that a filter of the keys takes for named ones are shuffled to them."""
    if keys.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keys), _same(here), "left_anti")
    name = fresh(rows, "_named")[0]
    tested = _sieved(rows, keys, here, name)
    return tested.filter(~F.col(name)).select(rows.columns).unionByName(tested.filter(name).join(keys, _same(here), "left_anti").select(rows.columns))


def among(rows: DataFrame, keys: DataFrame, here: dict[str, Column], most: int) -> DataFrame:
    """The rows that a key names, joined with all columns of keys, in the same way."""
    if keys.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keys), _same(here))
    name = fresh(rows, "_named")[0]
    return _sieved(rows, keys, here, name).filter(name).drop(name).join(keys, _same(here))
