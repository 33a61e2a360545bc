"""N-gram Jaccard self-join and its connected components.

1. Texts become sets of hashed word shingles, sorted. Equal sets are one node.
2. Any one order of all shingles will do for prefix filtering: two sets that link share one of their first
   n - ceil(t n) + 1 shingles in that order. Shingles that were seen repeatedly within a chunk of documents go last,
   the more often the later, so that passages which many documents share hardly ever are in a prefix.
3. Tiles: a prefix shingle and a band of sizes, each band reaching from some size to that size / t. A set is at home
   in the tile of its band, and a guest in that of the band above, so sets whose sizes can link meet in one tile. Of
   two sets that link, the smaller one has their first common shingle early in its prefix; only such early entries
   are guests, and a tile without one has no pairs.
4. Star round: in each tile every set is held against one leader, which is linear in the tile; a set keeps the leader
   that it meets in most tiles, and the links found are contracted to components. A tile whose sets are all of one
   component is done.
5. In the other tiles the sets of different components are held against one another.
6. A candidate pair is first decided by hashed bitmap signatures: a bit that only one of both has set is an element
   that the other lacks, so bit counts bound the overlap from above. Pairs that pass are decided by exact
   intersection of the sorted arrays, which are computed anew for the few documents that come so far rather than
   kept for all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.llm.bloom import BITMAP, among, apart, filter_bits, filter_of, position_pair
from sluicebox.llm.common import MOST_IDS, batches_of, fresh, park, small_batches
from sluicebox.llm.graph import components

#: Shingles of a chunk that are sorted at once when repeated ones are looked for.
CHUNK = 1 << 21
#: Most repeated shingles that order the others; beyond it only the commonest are told apart. It bounds what is
#: broadcast and changes no result.
MOST_COMMON = 1 << 19
#: Rows in a batch of pairs of sets.
PAIRS = 128
#: Most candidate sets whose ids are broadcast to find their signatures.
MOST_SIGNED = 500_000
#: Most documents with candidates whose ids are broadcast to find their texts again, some 20 MB; beyond it only texts
#: that a filter takes for theirs shuffle.
MOST_NODES = 300_000
#: Most bits of the filter of shared shingles. One that is too small for its rows lets more rows through.
MOST_BITS = 1 << 28
_SIEVE = 1 << 22


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of all windows of k words; of the whole sequence if it has fewer; none without
    words. Words are what white space separates, in lower case as far as A-Z goes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    width = min(k, len(words))
    rows = len(words) - width + 1
    h = np.full(rows, 0x9E3779B97F4A7C15 * (width + 1) % 2**64, np.uint64)
    for j in range(width):
        h = (h ^ hashes[j : j + rows]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(found: np.ndarray) -> bytes:
    """A bitmap of the bits that the elements of a set hash to, 2 to 4 of them for each element: a power of two, so
    that a longer bitmap folds to a shorter one."""
    width = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    bits = np.zeros(width, bool)
    bits[((found >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def overlap_bound(n: int, first: bytes, m: int, second: bytes) -> int:
    """The most elements that sets of n and m elements with these signatures can share: a bit that only one has is
    an element that the other lacks."""
    p, q = np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


class Order:
    """The order of all shingles: levels of the common ones, 0 for others, and within a level by hash."""

    def __init__(self, common: np.ndarray, levels: np.ndarray):
        at = np.argsort(common)
        self.common, self.levels = common[at], levels[at]
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[(common & np.uint64(_SIEVE - 1)).astype(np.int64)] = True

    def __reduce__(self):
        return Order, (self.common, self.levels)

    def first(self, found: np.ndarray, n: int) -> np.ndarray:
        """The first n of a sorted set."""
        maybe = np.flatnonzero(self.sieve[(found & np.uint64(_SIEVE - 1)).astype(np.int64)])
        if not len(maybe):
            return found[:n]
        at = np.searchsorted(self.common, found[maybe])
        at[at == len(self.common)] = 0
        level = np.zeros(len(found), np.uint8)
        level[maybe] = np.where(self.common[at] == found[maybe], self.levels[at], 0)
        return found[np.argsort(level, kind="stable")[:n]]


def common_shingles(docs: DataFrame, text_col: str, k: int) -> Order:
    """Counts all shingles of all documents chunk by chunk, and orders those that some chunk holds twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            again = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[again].view(np.int64)), pa.array(n[again].astype(np.int64))], names=["s", "n"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text, k)
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    seen = docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    seen = park(seen.withColumn("level", F.floor(F.log2("n")).cast("int")), "common")
    room, least = MOST_COMMON, 64
    for level, n in sorted(seen.groupBy("level").count().collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    rows = seen.filter(F.col("level") >= least).select("s", "level").toPandas()
    return Order(rows["s"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.uint8))


class NgramJoin:
    """Documents link when den * |A & B| >= num * |A | B| for their sets of k-word shingles."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100):
        """`nodes` holds a row per document, `links` verified links between different sets that connect all that
        link, and groups() the components. Null texts and texts without words have no shingles and link with
        nothing. Rows that repeat are documents of their own with equal sets. Other columns are not read."""
        self.docs, self.id_col, self.text_col, self.k, self.num, self.den = docs, id_col, text_col, k, num, den
        small_batches(docs.sparkSession)
        self.nodes = self._nodes()
        # Copies are the rows whose set an earlier row has.
        full = self.nodes.filter("n > 0").select("row", "print")
        heads = full.groupBy("print").agg(F.min("row").alias("node"), F.count("*").alias("c")).filter("c > 1")
        self.heads = park(heads.select("print", "node"), "heads")
        copies = full.join(self.heads, "print").filter("row <> node").select("row", "node")
        self.copies = park(copies, "copies")
        few = self.copies.limit(MOST_IDS + 1).count() <= MOST_IDS
        gone = self.copies.select("row")
        self.sets = self.nodes.filter("n > 0").join(F.broadcast(gone) if few else gone, "row", "left_anti").withColumnRenamed("row", "node").select("node", "n", "prefix")
        self._tiles()
        self.links = self._links()

    def _nodes(self) -> DataFrame:
        """A row per document: row, id, text_hash, n, print (of the whole set), sig (its bitmap) and prefix (its first
        shingles)."""
        order, k, num, den = common_shingles(self.docs, self.text_col, self.k), self.k, self.num, self.den
        sent = self.docs.sparkSession.sparkContext.broadcast(order)
        slim = self.docs.select(F.col(self.id_col).alias("id"), F.xxhash64(F.col(self.text_col)).alias("text_hash"), F.col(self.text_col).alias("_text"))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, prints, prefixes, sigs = [], [], [], []
                for text in batch.column(2).to_pylist():
                    found = shingles(text, k)
                    n = len(found)
                    sizes.append(n)
                    prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sigs.append(signature(found))
                    prefixes.append(sent.value.first(found, n - -(-num * n // den) + 1).view(np.int64) if n else found.view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), lists], names=["id", "text_hash", "n", "print", "sig", "prefix"])

        schema = T.StructType([*slim.schema[:2], T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
        return park(slim.mapInArrow(measure, schema).withColumn("row", F.monotonically_increasing_id()), "documents")

    def _tiles(self) -> None:
        """`entries`: (s, node, n, pos, band, early) for prefix shingles that several sets have, and for a few more
        that a Bloom filter of those takes for them, which meet nothing."""
        shared = self.sets.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").select("s")
        shared = park(shared, "shared")
        bits = filter_bits(2 * shared.count(), max_bits=MOST_BITS)
        maps = park(filter_of(shared, "s", bits), "filter")
        # At most MOST_BITS / 8 bytes.
        table = np.zeros(bits // 8, np.uint8)
        for row in maps.toLocalIterator():
            table[row["bucket"] * BITMAP // 8 : (row["bucket"] + 1) * BITMAP // 8] = np.frombuffer(row["bitmap"], np.uint8)
        sent = self.docs.sparkSession.sparkContext.broadcast(table)
        step, num, den = math.log(self.den / self.num), self.num, self.den
        places = self.sets.select("node", "n", "prefix", F.transform("prefix", lambda s: position_pair(s, bits)).alias("at"))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    lengths = pa.compute.list_value_length(part.column(2)).to_numpy()
                    s, at = part.column(2).flatten().to_numpy(), part.column(3).flatten().flatten().to_numpy()
                    held = ((sent.value[at // 8] >> (at % 8).astype(np.uint8)) & 1).reshape(-1, 2).all(axis=1)
                    row = np.repeat(np.arange(part.num_rows), lengths)
                    pos = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    n = part.column(1).to_numpy()[row[held]]
                    band = np.floor(np.log(n) / step + 1e-9).astype(np.int32)
                    early = n - pos[held] >= -(-2 * num * n // (num + den))
                    yield pa.RecordBatch.from_arrays([pa.array(s[held]), part.column(0).take(pa.array(row[held])), pa.array(n), pa.array(pos[held].astype(np.int32)), pa.array(band), pa.array(early)], names=["s", "node", "n", "pos", "band", "early"])

        self.entries = park(places.mapInArrow(pick, "s long, node long, n long, pos int, band int, early boolean"), "entries")

    def _needed(self, n: Column, m: Column) -> Column:
        """The least overlap with which sets of these sizes link."""
        return F.ceil((n + m) * self.num / F.lit(float(self.den + self.num)) - 1e-6)

    def _fits(self, x: str, y: str) -> Column:
        """Whether sizes allow a link, and this shingle can be the first that both have."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        rest = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
        return (self.den * F.least(n, m) >= self.num * F.greatest(n, m)) & (rest >= self._needed(n, m))

    def _met(self, entries: DataFrame) -> DataFrame:
        """Every entry in the tile of its band, and early ones as guests in that of the band above."""
        tiles = F.when(F.col("early"), F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.col("band")))
        return entries.withColumn("tile", F.explode(tiles))

    def _star(self) -> DataFrame:
        """Pairs of each set with a leader that it meets. A tile's leader is the set in which the shingle comes
        first, since it has the fewest rare shingles of its own and is the likeliest to be what the others were
        copied from. Among equals shingles choose by parity, so that one unlucky choice doesn't split a group. Tiles
        of one set, or without an early entry, have no leader."""
        luck = F.xxhash64("node", F.pmod("s", F.lit(2)))
        lead = self._met(self.entries).groupBy("s", "tile").agg(F.min(F.struct("pos", luck.alias("luck"), "node", "n")).alias("y"), F.count("*").alias("c"), F.max("early").alias("any"))
        lead = park(lead.filter("c > 1 and any").select("s", "tile", "y.node", "y.n", "y.pos"), "leaders").alias("y")
        x = self._met(self.entries).alias("x")
        pairs = x.join(lead, (F.col("x.s") == F.col("y.s")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.node") != F.col("y.node")) & self._fits("x", "y"))
        times = pairs.groupBy(F.col("x.node").alias("x"), F.col("y.node").alias("y")).agg(F.count("*").alias("c"))
        best = times.groupBy("x").agg(F.max(F.struct(F.col("c"), (-F.col("y")).alias("y"))).alias("best")).select("x", (-F.col("best.y")).alias("y"))
        return park(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")

    def _across(self, comps: DataFrame) -> DataFrame:
        """Pairs of different components that meet in a tile: the smaller set, which is early there, with others at
        home in the tile."""
        named = self.entries.join(comps.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("_n")
        named = park(named, "named")
        met = self._met(named)
        mixed = met.groupBy("s", "tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("early").alias("any")).filter("low <> high and any").select("s", "tile")
        mixed = park(mixed, "mixed")
        smaller = park(met.filter("early").join(mixed, ["s", "tile"], "left_semi"), "smaller").alias("x")
        larger = park(named.withColumn("tile", F.col("band")).join(mixed, ["s", "tile"], "left_semi"), "larger").alias("y")
        once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
        pairs = smaller.join(larger, (F.col("x.s") == F.col("y.s")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.comp") != F.col("y.comp")) & once & self._fits("x", "y"))
        return park(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")

    def _contents(self, pairs: DataFrame) -> DataFrame:
        """(node, items) of the sets in the pairs, from their texts. Rows that repeat id and text repeat here."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = park(self.nodes.join(wanted, F.col("row") == F.col("node")).select("node", F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "wanted")
        texts = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("_text"))
        texts = among(texts, wanted, {"_id": F.col("id"), "_hash": F.xxhash64("_text")}, MOST_NODES).select("node", "_text")
        k = self.k

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found = [shingles(t, k).view(np.int64) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "items"])

        return park(texts.mapInArrow(compute, "node long, items array<long>"), "contents")

    def _signed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their signatures let pass."""
        wanted = park(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "candidates")
        few = wanted.limit(MOST_SIGNED + 1).count() <= MOST_SIGNED
        signed = park(self.nodes.join(F.broadcast(wanted) if few else wanted, "row").select("row", "n", "sig"), "signatures")
        x = signed.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = signed.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        num, den = self.num, self.den

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = (batch.column(k).to_numpy() for k in (2, 4))
                least = -(-num * (n + m) // (num + den))
                keep = [overlap_bound(p, x, q, y) >= t for p, x, q, y, t in zip(n.tolist(), batch.column(3).to_pylist(), m.tolist(), batch.column(5).to_pylist(), least)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(test, "a long, b long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        num, den = self.num, self.den
        held = park(self._signed(pairs), "held")
        sets = self._contents(held)
        both = held.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch.column(2), batch.column(3)
                keep = []
                for i in range(batch.num_rows):
                    p, q = (c[i].values.to_numpy().view(np.uint64) for c in (left, right))
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    common = int((q[at] == p).sum())
                    keep.append(den * common >= num * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        with batches_of(self.docs.sparkSession, PAIRS):
            return park(both.select("a", "b", "ia", "ib").mapInArrow(decide, "a long, b long").distinct(), "links")

    def _links(self) -> DataFrame:
        star = self._star()
        links = self._verified(star)
        first = components(links)
        rest = park(self._across(first).join(star, ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            self.comps = first
            return links
        more = self._verified(rest)
        if more.isEmpty():
            self.comps = first
            return links
        one = first.select(F.col("node").alias("_n"), "comp")
        name = lambda df, x: df.join(one, F.col(x) == F.col("_n"), "left").withColumn(x, F.coalesce("comp", x)).drop("_n", "comp")
        second = components(name(name(more, "a"), "b")).select(F.col("node").alias("_c"), F.col("comp").alias("_to"))
        known = first.unionByName(second.join(first, F.col("_c") == F.col("node"), "left_anti").select(F.col("_c").alias("node"), F.col("_c").alias("comp")))
        self.comps = park(known.join(second, F.col("comp") == F.col("_c"), "left").select("node", F.coalesce("_to", "comp").alias("comp")), "components")
        return links.unionByName(more)

    def groups(self) -> DataFrame:
        """One row per document: row, id, n_shingles, component_id (the smallest id of its component), and leads,
        true for one row of each component, the first of those with that id. Documents without shingles are
        components of their own."""
        docs = self.nodes.select("row", "id", "n")
        comps = self.comps.select(F.col("node").alias("_m"), "comp")
        copies = self.copies.select(F.col("row").alias("_r"), "node")
        full = docs.filter("n > 0").join(copies, F.col("row") == F.col("_r"), "left").withColumn("node", F.coalesce("node", "row"))
        # A set that has many copies or links is one key of many rows here: both sides come from written tables.
        full = park(full.select("row", "id", "n", "node"), "placed")
        full = park(full.join(comps, F.col("node") == F.col("_m"), "left").select("row", "id", "n", F.coalesce("comp", "node").alias("comp")), "labelled")
        best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
        heads = park(full.groupBy("comp").agg(best.alias("best")).select(F.col("comp").alias("_c"), F.col("best.id").alias("component_id"), F.col("best.row").alias("_row")), "heads")
        full = full.join(heads, F.col("comp") == F.col("_c")).select("row", "id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("_row")).alias("leads"))
        empty = docs.filter("n = 0").select("row", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("leads"))
        return full.unionByName(empty).select("row", F.col("id").alias(self.id_col), "n_shingles", "component_id", "leads")

    def first_of_each(self) -> DataFrame:
        """The rows of docs, with all their columns, of which one document of each component stays: that with the
        smallest id. Dropped rows are named by id and hash of the text; of rows that repeat both, one stays."""
        docs = self.docs
        name, digest, stays, copies, size = fresh(docs, "_id", "_hash", "_stays", "_rows", "_n")
        rows = self.groups().select("row", "leads").join(self.nodes.select("row", "id", "text_hash", "n"), "row")
        keys = rows.groupBy(F.col("id").alias(name), F.col("text_hash").alias(digest))
        keys = park(keys.agg(F.max("leads").alias(stays), F.count("*").alias(copies), F.max("n").alias(size)), "verdicts")
        here = {name: F.col(self.id_col), digest: F.xxhash64(F.col(self.text_col))}
        repeated = (F.col(copies) > 1) & (F.col(size) > 0)
        off = keys.filter(~F.col(stays) | repeated).select(name, digest)
        plain = apart(docs, off, here, MOST_IDS)
        again = keys.filter(F.col(stays) & repeated).select(name, digest)
        if again.isEmpty():
            return plain
        return plain.unionByName(among(docs, again, here, MOST_IDS).dropDuplicates([name, digest]).select(docs.columns))


def ngram_join(docs: DataFrame, **options) -> NgramJoin:
    return NgramJoin(docs, **options)
