import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicebox.llm.queries import QUERIES
from sluicebox.llm.quality_rules import FUNCTION_WORDS, counts, estimate, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", "  ", "\n", "\t", "\r\n", "#", "é", " ", "<|", "a b a b a"]), max_size=40).map("".join) | st.none(), max_size=12))
def test_counts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in counts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts(spark):
    prose = lambda i: " ".join(f"word{(i * 31 + k * k) % 997} the" for k in range(60))
    rows = [(i, prose(i)) for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{i}{k}### $$$ %%%" for k in range(60))) for i in range(10)]  # symbols only
    rows += [(2000 + i, f"same{i} line again here\n" * 40) for i in range(10)]
    rows += [(3000, None), (3001, ""), (3002, "few words"), (None, prose(5)), (3, prose(3)), (3003, "long " * 100_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = [(r.doc_id, r.kept, r.base_failed, r.quality) for r in judge(docs).collect()]
    assert len(got) == len(rows)
    for i, kept, failed, quality in got:
        assert 0 <= quality <= 1 and not (kept and failed)
        assert kept == (i is None or i < 1000), (i, quality)
    assert judge(docs.limit(0)).collect() == []


def test_agreement_moves_accuracy():
    """A rule whose bad votes come alone is believed less than one that others agree with."""
    rules = ["a", "b", "c"]
    patterns = [((1, 1, 1), 9000), ((-1, -1, 1), 500), ((-1, 1, 1), 20), ((1, 1, -1), 300)]
    fit = estimate(patterns, rules)
    both, alone = fit.weights((-1, -1, 1))[0], fit.weights((1, 1, -1))[0]
    assert both < 0.01 < alone < 0.5 and fit.weights((1, 1, 1))[0] > 0.95
    assert abs(estimate([], rules).weights((1, 0, -1))[0] - 0.8) < 1e-9


def plain_votes(text):
    """The seven rules, one text at a time."""
    text = text or ""
    n, chars, symbols, dup, repeats = brute(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper = len(re.findall("[A-Z]", text))
    known = re.search(rf"(?<!\w)({FUNCTION_WORDS.replace(' ', '|')})(?!\w)", text, re.IGNORECASE)
    if not n:
        return [-1, 0, 0, 0, 0, 0, 0]
    pick = lambda bad, good: -1 if bad else int(good)
    return [
        pick(n < 50, n >= 80),
        pick(chars / n < 2.5 or chars / n > 11, 3.5 <= chars / n <= 9),
        pick(symbols / n > 0.1, symbols / n <= 0.02),
        pick(dup / len(lines) > 0.3, dup / len(lines) <= 0.05),
        pick(repeats / n > 0.5, repeats / n <= 0.15),
        pick(upper / chars > 0.4, upper / chars <= 0.15),
        pick(not known and n >= 20, known is not None),
    ]


def plain_posteriors(votes):
    """The same mixture fitted with one row per document instead of counted patterns."""
    votes = np.array(votes)
    docs, rules = votes.shape
    bad = votes < 0
    fired = bad.sum(1)
    held = np.zeros((docs, rules + 1))
    held[:, 0] = np.select([fired == 0, fired == 1], [0.99, 0.25], 0.05)
    held[:, 1:] = np.where((fired == 0)[:, None], 0.01 / rules, bad * ((1 - held[:, 0]) / np.maximum(fired, 1))[:, None])
    cells = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(40):
        share = held.sum(0) + 0.01
        tables = np.einsum("dc,drv->crv", held, cells) + 0.01
        tables /= tables.sum(2, keepdims=True)
        own = tables[np.arange(1, rules + 1), np.arange(rules), 0]
        tables[0, :, 0] = np.minimum(tables[0, :, 0], own)
        logs = np.log(share / share.sum()) + np.einsum("drv,crv->dc", cells, np.log(tables))
        held = np.exp(logs - logs.max(1, keepdims=True))
        held /= held.sum(1, keepdims=True)
    return held[:, 0]


def test_registered_against_brute_force(spark):
    """Verdicts of the whole table, from votes and an estimate worked out anew."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    good = plain_posteriors([plain_votes(r.text) for r in docs])
    want = {}
    for r, q in zip(docs, good):
        n, chars, symbols, dup, repeats = brute(r.text)
        failed = n < 50 or 100 * repeats > 50 * n
        want[r.doc_id] = (n, chars, symbols, dup, repeats, failed, bool(not failed and q >= 0.5))
    name = next(n for n in QUERIES if n.startswith("op4_"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in QUERIES[name](spark, folder).collect()}
    assert got == want and 0 < sum(w[-1] for w in want.values()) < len(want)
    found = {r.doc_id: r.quality for r in judge(spark.createDataFrame(docs)).collect()}
    assert np.allclose([found[r.doc_id] for r in docs], good, atol=1e-6)
