"""Mixing sources to target weights.

The words of each source, its documents in an order made by a hash, are one stream that is cut into blocks of
`block` words. A source's target says how many block slots it gets. Source counts are drawn from a multinomial
distribution for each output shard of `shard` slots; what the draws give a source beyond its slots is cut, and one
more shard settles what they leave short, so that every source ends at its target. Slot j of a source stands for
block p(j mod blocks) of round j div blocks, where p is a pseudorandom permutation of the block indices for that
source and round (a Feistel network, walked until it lands inside), and blocks join slots by index.

Places of documents in their source's stream, and of a shard's slots among those of its source, are running totals
over a total order, so that a source with a third of all rows is dealt out like the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.llm.common import WORD, fresh, park, small_batches, word_count
from sluicebox.storage import global_index, running_totals

#: Most sources whose targets are worked out on the driver and whose shares are broadcast. With more of them both are
#: done by aggregates and joins; targets and slots are the same.
MOST_SOURCES = 100_000
#: Slots that one row is exploded to.
RUN = 10_000


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of all words by weight; no source gets more than `most` times its size, and what is left over is
    shared anew by weight among the others until none is above."""
    sizes = [float(s) for s in sizes]
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum((most * s for s, c in zip(sizes, capped) if c), 0.0)
        free = sum(w for w, c in zip(weights, capped) if not c)
        found = [most * s if c else left * w / free for s, w, c in zip(sizes, weights, capped)]
        over = [i for i, (s, t, c) in enumerate(zip(sizes, found, capped)) if not c and t > most * s]
        if not over or not free:
            return found
        for i in over:
            capped[i] = True


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..size-1 sends each index; all arguments are arrays of equal length."""
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, half, mask, key):
        a, b = x >> half, x & mask
        for k in range(4):
            h = (b + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ key
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h ^ (h >> np.uint64(31))) & mask)
        return (a << half) | b

    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo], half[todo], mask[todo], key[todo])
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


class Mix:
    """The mix of a table: `table` of its sources, and as DataFrames `rows`, `slots`, `pieces` and taken()."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), block: int = 256, shard: int = 512, most: float = 3, seed: int = 1):
        """Sources by code point, null last, have the weights in turn; there may be any number of them. `most` bounds
        how often a document is taken and is a whole number. Null texts have no words. Rows that repeat count each. An
        empty table has no sources and no slots. Other columns are not read."""
        self.docs, self.id_col, self.text_col, self.block, self.shard, self.seed = docs, id_col, text_col, block, shard, seed
        self.spark = docs.sparkSession
        slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h"))
        slim = park(slim, "sizes")
        sums = park(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
        self.few = sums.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
        wanted = self._targets_here(sums, weights, most) if self.few else self._targets_there(sums, weights, most)
        size, words = F.col("source_size"), F.least(F.round("target").cast("long"), F.col("source_size") * int(most))
        full, rest = F.floor(words / F.greatest(size, F.lit(1))).cast("long"), words % F.greatest(size, F.lit(1))
        blocks = F.ceil(size / F.lit(block)).cast("long")
        slots = full * blocks + F.ceil(rest / F.lit(block)).cast("long")
        last = F.when(rest > 0, (rest - 1) % block + 1).otherwise(0).cast("long")
        self.table = park(wanted.select("sid", "source", "source_size", "target", blocks.alias("blocks"), slots.alias("slots"), last.alias("last")), "table")
        named = slim.join(self._side("sid", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
        # A document's first word in its source's stream: a sum over a total order, whatever the size of the source.
        placed = running_totals(named, "sid", {"start": F.col("size")}, F.xxhash64("id", F.lit(seed)), F.col("id"), F.col("h"), F.col("size"))
        self.rows = park(placed, "rows")
        self.slots = park(self._slots(), "slots")
        self.pieces = self._pieces()

    def _side(self, *columns) -> DataFrame:
        """Columns of the sources' table for a join, broadcast if there are few."""
        side = self.table.select(*columns)
        return F.broadcast(side) if self.few else side

    def _targets_here(self, sums: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
        found = sorted(((r["source"], int(r["source_size"])) for r in sums.collect()), key=lambda x: (x[0] is None, str(x[0])))
        own = [float(weights[i % len(weights)]) for i in range(len(found))]
        rows = [(i, name, size, target) for i, ((name, size), target) in enumerate(zip(found, targets([s for _, s in found], own, most)))]
        kind = T.StructType([T.StructField("sid", T.LongType()), T.StructField("source", sums.schema["source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
        return self.spark.createDataFrame(rows, kind)

    def _targets_there(self, sums: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
        """targets() as rounds of aggregates over the table of sources: each caps the sources above their bound."""
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
        rows = global_index(sums, F.col("source").isNull(), F.col("source"), name="sid").withColumn("weight", weight).withColumn("capped", F.lit(False))
        bound = F.col("source_size") * float(most)
        while True:
            rows = park(rows, "targets")
            total, taken, free = rows.agg(F.sum("source_size"), F.sum(F.when(F.col("capped"), bound).otherwise(0.0)), F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0))).first()
            share = (float(total) - taken) * F.col("weight") / F.lit(free or 1.0)
            rows = rows.withColumn("target", F.when(F.col("capped"), bound).otherwise(share)).withColumn("over", ~F.col("capped") & (F.col("target") > bound))
            if not free or rows.filter("over").isEmpty():
                return rows.select("sid", "source", "source_size", "target")
            rows = rows.withColumn("capped", F.col("capped") | F.col("over")).drop("target", "over")

    def _drawn(self, total: int, shards: int) -> DataFrame:
        """(shard, sid, n): multinomial source counts of every shard."""
        seed, length = self.seed, self.shard
        if self.few:
            # One number per source, of which there are at most MOST_SOURCES.
            known = sorted((r["sid"], r["slots"]) for r in self.table.select("sid", "slots").collect())
            sent = self.spark.sparkContext.broadcast(np.array([n for _, n in known], np.int64))

            def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                share = sent.value / max(1, total)
                for batch in batches:
                    out = []
                    for shard in batch.column(0).to_numpy():
                        n = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(min(length, total - int(shard) * length), share)
                        sid = np.flatnonzero(n)
                        out.append((np.full(len(sid), shard), sid, n[sid]))
                    columns = [np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)]) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "sid", "n"])

            return self.spark.range(shards).mapInArrow(draw, "shard long, sid long, n long")
        # Each slot draws one of all places at random, and places belong to sources in the measure of their slots.
        sources = running_totals(self.table.select("sid", "slots").withColumn("all", F.lit(0)), "all", {"at": F.col("slots")}, F.col("sid")).filter("slots > 0")
        sources = sources.select("sid", F.col("at").alias("low"), (F.col("at") + F.col("slots")).alias("high"))
        runs = sources.select("sid", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / RUN))).alias("k"))
        low = F.col("low") + F.col("k") * RUN
        places = runs.select("sid", F.explode(F.sequence(low, F.least(F.col("high"), low + RUN) - 1)).alias("place"))
        slots = self.spark.range(total).select(F.floor(F.col("id") / length).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("_place"))
        return slots.join(places, F.col("_place") == F.col("place")).groupBy("shard", "sid").agg(F.count("*").alias("n"))

    def _slots(self) -> DataFrame:
        """(shard, sid, j, block, part): part is null for a slot that takes its whole block, else its words."""
        seed, length = self.seed, self.shard
        total = int(self.table.agg(F.sum("slots")).first()[0] or 0)
        shards = -(-total // length)
        drawn = running_totals(park(self._drawn(total, shards), "draws"), "sid", {"first": F.col("n")}, F.col("shard"))
        info = self._side(F.col("sid").alias("_sid"), "blocks", "slots", "last")
        got = drawn.groupBy("sid").agg(F.sum("n").alias("got"))
        left = self.table.select("sid", "slots").join(got, "sid", "left")
        short = left.select(F.lit(shards).cast("long").alias("shard"), "sid", (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n"), F.coalesce("got", F.lit(0)).alias("first")).filter("n > 0")
        runs = drawn.select("shard", "sid", "n", "first").unionByName(short).join(info, F.col("sid") == F.col("_sid")).drop("_sid")
        runs = runs.withColumn("n", F.least(F.col("n"), F.col("slots") - F.col("first"))).filter("n > 0")
        pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))
        runs = runs.withColumn("k", F.explode(pieces)).withColumn("from", F.col("first") + F.col("k") * RUN)
        each = runs.select("shard", "sid", "blocks", "slots", "last", F.explode(F.sequence(F.col("from"), F.least(F.col("first") + F.col("n"), F.col("from") + RUN) - 1)).alias("j"))
        part = F.when((F.col("j") == F.col("slots") - 1) & (F.col("last") > 0), F.col("last"))
        each = each.select("shard", "sid", "j", "blocks", part.alias("part"))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sid, j, blocks = (batch.column(k).to_numpy() for k in (1, 2, 3))
                if not len(j):
                    continue
                key = (np.uint64(seed) << np.uint64(48)) ^ (sid.astype(np.uint64) << np.uint64(16)) ^ (j // blocks).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(permuted(j % blocks, blocks, key), pa.int64()), batch.column(4)], names=["shard", "sid", "j", "block", "part"])

        return each.mapInArrow(locate, "shard long, sid long, j long, block long, part long")

    def _pieces(self) -> DataFrame:
        """(sid, start, word, n, times, part): the words of one document in one block from its word `word` on, how
        often whole slots take them, and how many of them the slot takes that takes only a part."""
        size, length = F.col("size"), F.lit(self.block)
        cut = self.rows.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + size - 1) / length))).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * length)
        high = F.least(F.col("start") + size, (F.col("block") + 1) * length)
        cut = cut.select("sid", "start", "block", (low - F.col("start")).alias("word"), (high - low).alias("n"), (low - F.col("block") * length).alias("at"))
        used = self.slots.groupBy("sid", "block").agg(F.count_if(F.col("part").isNull()).alias("times"), F.max("part").alias("limit"))
        part = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("limit", F.lit(0)) - F.col("at")))
        return cut.join(used, ["sid", "block"]).select("sid", "start", "word", "n", "times", part.alias("part"))

    def taken(self) -> DataFrame:
        """One row per row of docs: id, size, source_size, target (of its source), taken (words, repeats counted)."""
        sums = self.pieces.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum(F.col("n") * F.col("times") + F.col("part")).alias("taken"))
        rows = self.rows.join(sums, (F.col("size") > 0) & (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")), "left")
        return rows.select(F.col("id").alias(self.id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as rows with the columns of docs: a document that is taken k times gives k rows, each with the
        words that its blocks contribute to that round; a round that has all of its words has its text unchanged,
        and one that has a part of them has those words joined by spaces."""
        small_batches(self.spark, 500)
        docs = self.docs
        name, digest, own, all_ = fresh(docs, "_id", "_h", "_own", "_copies")
        runs = self.pieces.groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("word", "n", "times", "part"))).alias("runs"))
        runs = self.rows.filter("size > 0").join(runs, ["sid", "start"]).select(F.col("id").alias(name), F.col("h").alias(digest), "size", "runs")
        # Rows that repeat id and text share a key: their runs stand side by side, and one of them carries all.
        runs = park(runs.groupBy(name, digest).agg(F.collect_list(F.struct("size", "runs")).alias(all_)), "runs")
        texts = docs.withColumn(own, F.xxhash64(F.col(self.text_col)))
        if not runs.filter(F.size(all_) > 1).isEmpty():
            texts = texts.dropDuplicates([self.id_col, own])
        both = texts.join(runs, F.col(self.id_col).eqNullSafe(F.col(name)) & (F.col(own) == F.col(digest))).select(*docs.columns, all_)
        names, at = list(docs.columns), docs.columns.index(self.text_col)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    rows, texts = [], []
                    for i, (text, copies) in enumerate(zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                        for found in (x for c in copies for x in layers(text, c["size"], c["runs"])):
                            rows.append(i)
                            texts.append(found)
                    kept = part.take(pa.array(rows, pa.int64()))
                    columns = [pa.array(texts, pa.string()) if k == at else kept.column(k) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return both.mapInArrow(cut, docs.schema)


_WORD = re.compile(WORD)


def layers(text: str, size: int, runs: list[dict]) -> Iterator[str]:
    """The texts that a document contributes, one for each time that any of its words is taken."""
    words = None
    for k in range(max((r["times"] for r in runs), default=0) + 1):
        spans = [(r["word"], r["n"] if r["times"] > k else r["part"] if r["times"] == k else 0) for r in runs]
        got = sum(n for _, n in spans)
        if got == size:
            yield text
        elif got:
            words = words or _WORD.findall(text)
            yield " ".join(w for at, n in spans for w in words[at : at + n])


def mix(docs: DataFrame, **options) -> Mix:
    return Mix(docs, **options)
