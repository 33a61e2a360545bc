"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the n-grams of the given orders hash into
2**bits buckets. Training counts buckets per language over a bounded sample of the labelled rows (at most about
`per_language` documents of each language, picked by a hash of the id). The log-probability matrix, buckets x
languages, goes to the executors, and whole texts are scored there in numpy a batch at a time: the n-grams of a batch
are one sparse matrix, texts x buckets, that is multiplied with it.

A matrix that would be larger than MOST_BYTES is sent in parts of languages, one after another; the best language and
the sum of all probabilities are carried from part to part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.llm.common import MOST_IDS, park, small_batches

#: n-grams that are looked up at once: few enough to stay in a processor's cache, whatever the batch or the text.
SLICE = 1 << 14
#: Most bytes of a matrix that is broadcast.
MOST_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str | None) -> np.ndarray:
    """Lower-cased code points with each run of non-letters as one space; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = points[keep]
    return np.concatenate(([32], kept if kept[-1] != 32 else kept[:-1], [32])).astype(np.uint32)


def buckets(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The bucket of every n-gram."""
    found = []
    for n in orders:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


class Part:
    """Some of the learned languages, in code point order, with their prior and the matrix buckets x languages of
    log-probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], bits: int, alpha: float = 0.5):
        self.languages, self.prior, self.orders, self.bits = languages, prior, orders, bits
        smooth = counts + alpha
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages: log of prior and likelihood; -inf in all of them for a text without a letter. The
        totals of a text don't depend on the others in its batch."""
        out = np.full((len(texts), len(self.languages)), -np.inf)
        held, size = [], 0
        for i, text in enumerate(texts):
            points = codes(text)
            if not len(points):
                continue
            out[i] = self.prior
            if held and size + len(points) > SLICE:
                self._add(out, held)
                held, size = [], 0
            held.append((i, points))
            size += len(points)
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        """Adds the n-grams of some texts, or of one long one, to their totals."""
        rows, lengths = np.array([i for i, _ in held]), np.array([len(p) for _, p in held])
        points, owner = np.concatenate([p for _, p in held]), np.repeat(np.arange(len(held)), lengths)
        for n in self.orders:
            grams = buckets(points, (n,), self.bits)
            whole = owner[: len(grams)] == owner[n - 1 :]
            grams, own = grams[whole], owner[: len(grams)][whole]
            # Several texts fit by the way they were gathered; one alone may need several slices.
            for at in range(0, len(grams), SLICE):
                part, here = grams[at : at + SLICE], own[at : at + SLICE]
                starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                out[rows[here[starts]]] += np.add.reduceat(self.logp[part], starts, axis=0)


@dataclass(frozen=True)
class Model:
    """What was learned: languages in code point order with their numbers of documents, and counts (lang, bucket, n)
    of the sample, which stay a table."""

    languages: list[str]
    documents: list[int]
    counts: DataFrame | None
    orders: tuple[int, ...]
    bits: int

    def parts(self) -> Iterator[Part]:
        """The languages in parts whose matrices have at most MOST_BYTES; the driver holds one at a time."""
        step = max(1, MOST_BYTES // (8 << self.bits))
        prior = np.log(np.array(self.documents, float) / max(1, sum(self.documents)))
        for at in range(0, len(self.languages), step):
            names = self.languages[at : at + step]
            rows = self.counts.filter(F.col("lang").between(names[0], names[-1])).toPandas()
            counts = np.zeros((len(names), 1 << self.bits))
            counts[rows.lang.map({n: i for i, n in enumerate(names)}).to_numpy(int), rows.bucket.to_numpy(int)] = rows.n.to_numpy(float)
            yield Part(names, counts, prior[at : at + step], self.orders, self.bits)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16) -> Model:
    """Learn from rows with a language that aren't held out. per_language bounds the sample, not the languages."""
    small_batches(docs.sparkSession)
    usable = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    unit = 1 << 30
    sizes = park(usable.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("n")), "languages")
    share = F.least(F.lit(unit).cast("long"), F.floor(F.lit(unit).cast("long") * per_language / F.col("n")) + 1)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(unit))
    wanted = sizes.select("_lang", share.alias("_share"))
    few = wanted.limit(MOST_IDS + 1).count() <= MOST_IDS
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("_place"))
    sample = rows.join(F.broadcast(wanted) if few else wanted, (F.col("lang") == F.col("_lang")) & (F.col("_place") < F.col("_share"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                into += np.bincount(buckets(codes(text), orders, bits), minlength=1 << bits)
        for lang, into in seen.items():
            full = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(into[full], pa.int64())], names=["lang", "bucket", "n"])

    counts = park(sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    # Two short values a language.
    known = sorted((r["_lang"], r["n"]) for r in sizes.toLocalIterator())
    return Model([x for x, _ in known], [n for _, n in known], counts, orders, bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    lang_pred is `und` and score 0 if the text is null or has no letter, or if nothing could be learned. Equal
    scores go to the language that comes first by code point. Only the id and the text are read; the id passes
    through. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    state = [T.StructField("_best", T.DoubleType()), T.StructField("_name", T.StringType()), T.StructField("_sum", T.DoubleType())]
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.lit(float("-inf")).alias("_best"), F.lit("und").alias("_name"), F.lit(0.0).alias("_sum"))
    parts = -(-len(model.languages) // max(1, MOST_BYTES // (8 << model.bits)))
    for k, part in enumerate(model.parts()):
        sent, last = spark.sparkContext.broadcast(part), k == parts - 1

        def predict(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                totals = sent.value.totals(batch.column(2).to_pylist())
                best, names, sums = (batch.column(i).to_pylist() for i in (3, 4, 5))
                at = totals.argmax(axis=1)
                top = totals[np.arange(len(at)), at]
                for i in np.flatnonzero(top > -np.inf):
                    high = max(best[i], float(top[i]))
                    # The sum of all probabilities over the best one's.
                    sums[i] = (sums[i] * float(np.exp(best[i] - high)) if sums[i] else 0.0) + float(np.exp(totals[i] - high).sum())
                    if top[i] > best[i]:
                        best[i], names[i] = high, sent.value.languages[at[i]]
                texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pa.array(best, pa.float64()), pa.array(names, pa.string()), pa.array(sums, pa.float64())], names=["id", "held_out", "text", "_best", "_name", "_sum"])

        rows = rows.mapInArrow(predict, T.StructType([*rows.schema[:3], *state]))
        if not last:
            # One matrix at a time on the executors.
            rows = park(rows, "scores")
    score = F.when(F.col("_sum") > 0, 1 / F.col("_sum")).otherwise(0.0)
    return rows.select(F.col("id").alias(id_col), "held_out", F.col("_name").alias("lang_pred"), score.alias("score"))
