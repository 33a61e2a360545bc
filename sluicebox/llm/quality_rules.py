"""Quality rules under weak supervision. [native]

Every rule looks at counts of a whole text and votes good, bad or abstains. The number of documents with each
combination of votes, at most 3 ** rules rows, is all that estimation needs: expectation-maximisation on those
counts finds the share of good documents and, for each rule, how accurate its votes are on good documents and on
those of each kind of defect. A document stays if its posterior
probability of being good is at least `threshold`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import SPACES, WORD, let, park

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = "the and of to in is that der die und das ist le la les et des est el los las que y en de un"
#: One of them between characters that are neither letters nor digits; what `\b` takes for letters depends on the JVM.
_KNOWN = rf"(?i)(?<![\p{{L}}\p{{N}}_])({FUNCTION_WORDS.replace(' ', '|')})(?![\p{{L}}\p{{N}}_])"


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more, each counted once."""
    hashes = F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

        def lengths(p: Column) -> Column:
            return _sum(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(placed, twins), lengths))

    return let(hashes, covered)


def _dup_lines(lines: Column) -> Column:
    """(lines with a word, those among them that equal an earlier one)."""
    full = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper, has_function_word. Null texts have no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), text.alias("_t"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), _repeat_words(words).alias("repeats"))

    slim = slim.select(
        id_col,
        let(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), of_words).alias("_w"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(F.split("_t", "\n", -1)).alias("_l"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.col("_t").rlike(_KNOWN).alias("has_function_word"),
    )
    return slim.select(id_col, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeats").alias("n_repeat_words"), "n_upper", "has_function_word")


def rule_votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 to abstain, from the counts."""
    n = F.col("n_words")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": F.when(n < 50, -1).when(n >= 80, 1).otherwise(0),
        "word_length": vote(F.col("word_chars").between(3.5 * n, 9 * n), (F.col("word_chars") < 2.5 * n) | (F.col("word_chars") > 11 * n)),
        "symbols": vote(100 * F.col("n_symbols") <= 2 * n, 100 * F.col("n_symbols") > 10 * n),
        "lines": vote(100 * F.col("n_dup_lines") <= 5 * F.col("n_lines"), 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "repeats": vote(100 * F.col("n_repeat_words") <= 15 * n, 100 * F.col("n_repeat_words") > 50 * n),
        "capitals": vote(100 * F.col("n_upper") <= 15 * F.col("word_chars"), 100 * F.col("n_upper") > 40 * F.col("word_chars")),
        "function_words": vote(F.col("has_function_word"), ~F.col("has_function_word") & (n >= 20)),
    }



@dataclass(frozen=True)
class Fit:
    """Classes of documents, the good one first and then one for the defect that each rule looks for: the share
    of each class, and for each class and rule how often the rule votes -1, 0 and 1."""

    rules: list[str]
    share: list[float]
    tables: list[list[list[float]]]

    def weights(self, votes: tuple[int, ...]) -> list[float]:
        """The classes' posterior probabilities for one pattern of votes."""
        logs = [math.log(p) + sum(math.log(t[v + 1]) for t, v in zip(rows, votes)) for p, rows in zip(self.share, self.tables)]
        most = max(logs)
        parts = [math.exp(x - most) for x in logs]
        return [x / sum(parts) for x in parts]

    def quality(self) -> Column:
        """Posterior probability of the good class, from columns of votes."""

        def log_weight(c: int) -> Column:
            total = F.lit(math.log(self.share[c]))
            for rule, t in zip(self.rules, self.tables[c]):
                vote = F.col(f"vote_{rule}")
                total = total + F.when(vote < 0, math.log(t[0])).when(vote > 0, math.log(t[2])).otherwise(math.log(t[1]))
            return total

        good = log_weight(0)
        odds = [F.exp(F.least(log_weight(c) - good, F.lit(500.0))) for c in range(1, len(self.share))]
        return 1 / sum(odds, F.lit(1.0))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 40, right: float = 0.75, smooth: float = 0.01) -> Fit:
    """Expectation-maximisation over counted vote patterns.

    Junk is of many kinds that set off different rules, so one class of bad documents would learn the commonest
    kind only; here each rule has a class of its own. Before the first round a bad vote counts as right with
    probability `right`, two or more with 0.95; agreement between rules then moves these accuracies. Tables are
    smoothed by a hundredth of a document per cell (more would, round by round, draw rare kinds of junk to the good
    class), and the good class casts no rule's bad vote more often than that rule's own
    class does. Without documents every class votes alike and the quality is the share of the good class.
    """
    k = len(rules) + 1
    fit = Fit(rules, [0.8] + [0.2 / len(rules)] * len(rules), [[[1 / 3] * 3 for _ in rules] for _ in range(k)])
    held = []
    for votes, _ in patterns:
        fired = [j + 1 for j, v in enumerate(votes) if v < 0]
        wrong = (1 - right if len(fired) == 1 else 0.05) if fired else 0.99
        held.append([wrong if c == 0 else (1 - wrong) / len(fired) if c in fired else 0.0 if fired else 0.01 / len(rules) for c in range(k)])
    for _ in range(rounds if patterns else 0):
        share, tables = [smooth] * k, [[[smooth] * 3 for _ in rules] for _ in range(k)]
        for (votes, n), h in zip(patterns, held):
            for c in range(k):
                share[c] += n * h[c]
                for j, v in enumerate(votes):
                    tables[c][j][v + 1] += n * h[c]
        tables = [[[x / sum(cells) for x in cells] for cells in rows] for rows in tables]
        for j in range(len(rules)):
            tables[0][j][0] = min(tables[0][j][0], tables[j + 1][j][0])
        fit = Fit(rules, [x / sum(share) for x in share], tables)
        held = [fit.weights(votes) for votes, _ in patterns]
    return fit


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, the counts, base_failed, votes, quality (posterior probability), kept.

    base_failed: under 50 words, or more than half of the words in repeated windows of three; such a row is never
    kept. Null and empty texts have no words. Only id and text are read; the id passes through. An empty table
    gives no rows.
    """
    votes = rule_votes()
    rated = park(counts(docs, id_col, text_col).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]), "votes")
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in rated.groupBy(*names).count().collect()]
    quality = estimate(sorted(patterns), list(votes)).quality()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rated.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
