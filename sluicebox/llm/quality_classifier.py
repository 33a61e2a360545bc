"""Quality classifier by hierarchical empirical Bayes.

A logistic scorecard over binned measures of a whole text, fitted on at most about `sample` labelled documents,
gives every document's own evidence. Grouped sums of that evidence give each host, and each path within a host, a
posterior rate of good documents: the host's is shrunk toward the global rate and the path's toward its host's, the
more the fewer documents there are, by strengths estimated from how much hosts and paths differ. A document's
quality combines its own log-odds with those of its site, which leave its own share out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import MOST_IDS, fresh, park, small_batches
from sluicebox.llm.quality_rules import FUNCTION_WORDS, SYMBOLS

#: Quantiles of the training sample at which each measure is cut into bins.
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
_UPPER, _DIGIT, _SYMBOL, _POINT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SYMBOLS.encode(), b".,;:!?"
_FREQUENT = frozenset(FUNCTION_WORDS.split())
WIDTH = 12
#: Most pairs of host and path that are broadcast.
MOST_SITES = MOST_IDS // 8


def measures(text: str | None) -> list[float] | None:
    """WIDTH measures of a text; None without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = n - 2
    seen = len(set(zip(words, words[1:], words[2:]))) if windows > 0 else 0
    letters = sum(map(len, words))
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    return [
        math.log(n),
        letters / n,
        without(_UPPER),
        without(_DIGIT),
        without(_SYMBOL),
        without(_POINT),
        raw.count(b"!") / size,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - seen / windows if windows > 0 else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(w in _FREQUENT for w in map(str.lower, words)) / n,
        n / max(1, len(lines)),
    ]


class Scorecard:
    """Log-odds as a sum over measures of the weight of the bin they fall in."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        """rows: documents x WIDTH; good: 0..1. Without both kinds of labels the log-odds are 0 everywhere."""
        self.cuts = [np.unique(np.quantile(rows[:, k], CUTS)) if len(rows) else np.empty(0) for k in range(WIDTH)]
        self.first = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts])))
        self.weights, self.base = np.zeros(int(self.first[-1])), 0.0
        if not len(rows) or good.min() > 0.5 or good.max() < 0.5:
            return
        x = np.zeros((len(rows), len(self.weights) + 1))
        x[np.arange(len(rows))[:, None], self._bins(rows)] = 1
        x[:, -1] = 1
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (good - p) - penalty * w
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), slope)
            w += step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.base = w[:-1], float(w[-1])

    def _bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.first[k] + np.searchsorted(self.cuts[k], rows[:, k], side="left") for k in range(WIDTH)], axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.weights[self._bins(rows)].sum(axis=1), -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Scorecard:
    """Learn from labelled documents that have words. sample bounds the labels used, picked by a hash of the id;
    rows without a label or an id aren't used, and an id with several labels has their mean."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_good"))
    n, unit = usable.count(), 1 << 30
    usable = usable.filter(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(unit)) < min(unit, unit * sample // max(1, n) + 1)).groupBy("_id").agg(F.avg("_good").alias("_good"))
    # At most about `sample` rows by the filter above.
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    known = texts.join(F.broadcast(usable), F.col("_key") == F.col("_id")).select("_good", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, m) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (m := measures(t))]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.float64()), pa.array([m for _, m in rows], pa.list_(pa.float64()))], names=["good", "m"])

    rows = known.mapInArrow(measure, "good double, m array<double>").toPandas()
    # Sums over documents depend on their order, which a join doesn't keep.
    table = np.array(sorted([g, *m] for g, m in zip(rows.good, rows.m))).reshape(-1, WIDTH + 1)
    return Scorecard(table[:, 1:], table[:, 0])


def _strength(groups: DataFrame, mean: Column, toward: Column, spread: float) -> float:
    """How many documents the prior of a level counts as: by moments, from how far group means lie from what they
    are shrunk toward, beyond what their sizes explain. Only three numbers reach the driver."""
    got = groups.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * (mean - toward) ** 2).alias("between")).first()
    if not got["n"]:
        return 1.0
    variance = got["between"] / got["n"] - spread * got["groups"] / got["n"]
    return max(1.0, min(1e6, spread / max(variance, 1e-9)))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _evidence(docs: DataFrame, model: Scorecard, text: Column) -> Column:
    """The probability that a text alone gives; null without words. Only texts go to the workers and back comes one
    number each, so a row's other columns stay where they are."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [measures(t) if isinstance(t, str) else None for t in texts.tolist()]
        full = [r for r in rows if r]
        found = iter(sent.value.probability(np.array(full)).tolist() if full else [])
        return pd.Series([next(found) if r else None for r in rows], dtype="float64")

    return score.asNondeterministic()(text)


class Sites:
    """Posteriors of hosts, and of paths within hosts, over parked rows with columns of host, path and evidence."""

    def __init__(self, scored: DataFrame, host: str, path: str, own: str):
        self.host, self.path, self.own = host, path, own
        full = scored.filter(F.col(own).isNotNull())
        paths = park(full.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").alias("n"), F.sum(own).alias("s")), "paths")
        total = full.agg(F.count(own), F.avg(own), F.var_pop(own)).first()
        self.rate, spread = (total[1], total[2]) if total[0] else (0.5, 0.25)
        hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        self.k_host = _strength(hosts, F.col("s") / F.col("n"), F.lit(self.rate), spread)
        hosts = hosts.select("_h", F.col("n").alias("hn"), F.col("s").alias("hs"))
        sites = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
        self.k_path = _strength(sites, F.col("s") / F.col("n"), (F.col("hs") + self.k_host * self.rate) / (F.col("hn") + self.k_host), spread)
        self.table = park(sites.select("_host", "_path", "n", "s", "hn", "hs"), "sites")
        self.few = self.table.limit(MOST_SITES + 1).count() <= MOST_SITES

    def rated(self, rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        """rows with the host's posterior, the path's, both without the row's own share, and the quality."""
        at_host, at_path, quality = names
        h, p, n, s, hn, hs = fresh(rows, "_h", "_p", "_n", "_s", "_hn", "_hs")
        sites = self.table.select(F.col("_host").alias(h), F.col("_path").alias(p), F.col("n").alias(n), F.col("s").alias(s), F.col("hn").alias(hn), F.col("hs").alias(hs))
        both = rows.join(F.broadcast(sites) if self.few else sites, F.col(self.host).eqNullSafe(F.col(h)) & F.col(self.path).eqNullSafe(F.col(p)), "left")
        own = F.col(self.own)
        both = both.withColumn(at_host, (F.col(hs) - own + self.k_host * self.rate) / (F.col(hn) - 1 + self.k_host))
        both = both.withColumn(at_path, (F.col(s) - own + self.k_path * F.col(at_host)) / (F.col(n) - 1 + self.k_path))
        odds = _logit(own) + _logit(F.col(at_path)) - _logit(F.lit(self.rate))
        return both.withColumn(quality, F.when(own.isNull(), 0.0).otherwise(1 / (1 + F.exp(-odds)))).drop(h, p, n, s, hn, hs)


def classify(docs: DataFrame, model: Scorecard, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, doc_quality (own evidence), host_quality and path_quality (shrunk posteriors
    without the document's own share), quality, and kept, which is true at the threshold and above.

    host and path default to the columns source and lang: a host's documents in one language are its path here.
    Null hosts and paths are groups like others. A text without words has quality 0 and isn't kept, and says
    nothing about its site. Rows that repeat count each. Other columns are not read; an empty table gives no rows.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    slim = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), _evidence(docs, model, F.col(text_col)).alias("doc_quality"))
    scored = park(slim, "evidence")
    rated = Sites(scored, "host", "path", "doc_quality").rated(scored, ("host_quality", "path_quality", "quality"))
    return rated.select(F.col("id").alias(id_col), "doc_quality", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, model: Scorecard, text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns. Rows are written once beside their evidence and
    filtered as they are read: while sites are few enough to broadcast, texts don't shuffle at all."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    h, p, own, *names = fresh(docs, "_host", "_path", "_own", "_at_host", "_at_path", "_quality")
    scored = park(docs.withColumns({h: host.cast("string"), p: path.cast("string")}).withColumn(own, _evidence(docs, model, F.col(text_col))), "evidence")
    rated = Sites(scored, h, p, own).rated(scored, tuple(names))
    return rated.filter(F.col(names[2]) >= threshold).select(docs.columns)
