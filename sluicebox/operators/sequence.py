"""Near-duplicate removal over an ordered sequence with a bounded queue of references."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.storage import global_index, park, spread


def with_batches(df: DataFrame, *order: Column, size: int = 100_000) -> DataFrame:
    """df with idx, its position in the order, and batch = idx div size."""
    return global_index(df, *order).withColumn("batch", F.floor(F.col("idx") / size).cast("long"))


class Queue:
    """The hashes that a new one is compared with: at most `most`, the oldest leaves first."""

    def __init__(self, threshold: int, most: int, hashes: list[int] = ()):
        self.threshold, self.hashes = threshold, deque(hashes, maxlen=most)

    def takes(self, value: int) -> bool:
        """True, and the hash joins the queue, if every reference is at least `threshold` bits away."""
        if any((value ^ h).bit_count() < self.threshold for h in self.hashes):
            return False
        self.hashes.append(value)
        return True


def fifo_dedup(hashes: DataFrame, key: str, order: str, hash_col: str, threshold: int = 14, most: int = 10) -> DataFrame:
    """The retained rows (key, order, hash) of each key, in the sense of Queue; rows without a hash are skipped.

    Rows are dealt by key, sorted, and run through as a stream: a task holds one Arrow batch and one queue however
    long a key's sequence is. The state depends on its own earlier output, so one key is one stream.
    """
    rows = hashes.select(key, order, hash_col).filter(F.col(hash_col).isNotNull())
    rows = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, now, begun = None, None, False
        for batch in batches:
            keep = []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or k != now:
                    queue, now, begun = Queue(threshold, most), k, True
                keep.append(queue.takes(h))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


#: Most keys that one band gives a hash.
MOST_KEYS = 1024


def _edges(bits: int, bands: int) -> list[int]:
    return [bits * k // bands for k in range(bands + 1)]


def band_count(n: int, threshold: int, bits: int = 63) -> int:
    """The number of bands with the least rows and candidates for n distinct hashes. With m bands, one differs in at
    most (threshold - 1) div m bits: few wide bands meet few others by chance but need many neighbouring keys."""

    def cost(bands: int) -> float:
        radius, edges = (threshold - 1) // bands, _edges(bits, bands)
        total = 0.0
        for width in (b - a for a, b in zip(edges, edges[1:])):
            keys = sum(math.comb(width, r) for r in range(radius + 1))
            if keys > MOST_KEYS:
                return math.inf
            total += 2.0 * n * (keys + 1) + n * n * keys / 2.0 / 2**width
        return total

    return min(range(1, max(1, min(threshold, bits)) + 1), key=cost)


def hash_links(hashes: DataFrame, hash_col: str, threshold: int, bits: int = 63, bands: int | None = None) -> DataFrame:
    """(x, y, distance) of all distinct hashes x < y fewer than `threshold` bits apart, by an equi-join.

    The smaller hash of a pair looks up, in each band of bits, all keys within the radius that some band of the pair
    is sure to have; the larger one stands under its own. A pair is reported at the first band that is within.
    """
    # Few hashes have many keys, so even a small table is dealt to all cores before they are made.
    rows = spread(park(hashes.select(F.col(hash_col).alias("h")).filter("h is not null").distinct(), "hashes"))
    bands = band_count(rows.count(), threshold, bits) if bands is None else bands
    radius, edges = (threshold - 1) // bands, _edges(bits, bands)
    width = [b - a for a, b in zip(edges, edges[1:])]
    cut = lambda h, k: F.shiftright(h, edges[k]).bitwiseAND(F.lit((1 << width[k]) - 1))
    flips = lambda w: [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(w), r)]
    near = {w: F.lit(flips(w)).cast("array<bigint>") for w in set(width)}
    own = F.array(*[F.struct(F.lit(k).alias("k"), cut(F.col("h"), k).alias("bits")) for k in range(bands)])
    beside = lambda k: F.transform(near[width[k]], lambda m: F.struct(F.lit(k).alias("k"), cut(F.col("h"), k).bitwiseXOR(m).alias("bits")))
    around = F.flatten(F.array(*[beside(k) for k in range(bands)]))
    small = rows.select(F.col("h").alias("x"), F.explode(around).alias("b")).select("x", F.col("b.k").alias("kx"), F.col("b.bits").alias("bx"))
    large = rows.select(F.col("h").alias("y"), F.explode(own).alias("b")).select("y", F.col("b.k").alias("ky"), F.col("b.bits").alias("by"))
    xor = F.col("x").bitwiseXOR(F.col("y"))
    met = small.join(large, (F.col("kx") == F.col("ky")) & (F.col("bx") == F.col("by")) & (F.col("x") < F.col("y")) & (F.bit_count(xor) < threshold))
    first = F.coalesce(*[F.when(F.bit_count(cut(xor, k)) <= radius, k) for k in range(bands)])
    return met.filter(F.col("kx") == first).select("x", "y", F.bit_count(xor).alias("distance"))


def hamming_pairs(hashes: DataFrame, id_col: str, hash_col: str, threshold: int, bits: int = 63, bands: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b fewer than `threshold` bits apart; rows without a hash have none. Only
    distinct hashes are compared (hash_links, which is what to use where many rows are equal): the ids of equal
    rows are paired when a link is written out."""
    # Narrow rows, read several times; computing their hashes may be costly.
    rows = park(hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h is not null"), "rows")
    links = hash_links(rows, "h", threshold, bits, bands)
    x, y = (rows.select(F.col("id").alias(i), F.col("h").alias(h)) for i, h in (("i", "p"), ("j", "q")))
    apart = links.join(x, F.col("x") == F.col("p")).join(y, F.col("y") == F.col("q")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").filter("a < b")
    equal = x.join(y, (F.col("p") == F.col("q")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(equal) if threshold > 0 else apart
