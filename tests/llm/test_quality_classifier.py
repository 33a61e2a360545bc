import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sluicebox.llm import quality_classifier
from sluicebox.llm.quality_classifier import Scorecard, classify, fit, keep_good, measures

GOOD = "the quick story of a fox and a dog that live in the old town by the river number {} with friends {}"
BAD = "BUY!!! NOW!!! $$$ ### CLICK!!! {} WIN!!! CASH!!! {} %%% &&&"


def test_measures():
    assert measures(None) is measures("") is measures(" \n") is None
    assert all(math.isfinite(x) for t in ("a", "a b", "a\na", "é" * 10_000) for x in measures(t))


def test_sites_and_edges(spark):
    rows = [(i, (GOOD if i % 3 else BAD).format(i, i * 7), "good.example" if i % 3 else "bad.example", "en") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "good.example", None), (None, GOOD.format(1, 2), None, "en"), (5, rows[5][1], "good.example", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' AS kept", "1 AS quality")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(1, None), (None, 1), (1000, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = classify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1000, 1001):
            assert not r.kept and r.quality == 0 and r.doc_quality is None
        else:
            assert r.kept == (r.doc_id is None or r.doc_id % 3 > 0) and 0 <= r.quality <= 1
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    # A site full of good documents speaks for one, and a host with a single document stays near the global rate.
    site = {r.doc_id: r for r in got if r.doc_id is not None}
    assert site[1].path_quality > site[0].path_quality
    assert classify(docs.limit(0), model).collect() == [] and keep_good(docs.limit(0), model).collect() == []
    nothing = fit(docs, labels.limit(0))
    assert all(r.kept == (r.doc_id not in (1000, 1001)) for r in classify(docs, nothing).collect())


def strength(groups, spread):
    """groups: (n, mean, toward) of each."""
    n = sum(g[0] for g in groups)
    variance = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) / n - spread * len(groups) / n
    return max(1.0, min(1e6, spread / max(variance, 1e-9)))


def posteriors(rows):
    """rows (host, path, own evidence): the three qualities of each, by definition and one group after the other."""
    full = [r for r in rows if r[2] is not None]
    rate, spread = float(np.mean([r[2] for r in full])), float(np.var([r[2] for r in full]))
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, q in full:
        hosts[h].append(q)
        paths[h, p].append(q)
    k = strength([(len(x), np.mean(x), rate) for x in hosts.values()], spread)
    shrunk = {h: (sum(x) + k * rate) / (len(x) + k) for h, x in hosts.items()}
    m = strength([(len(x), np.mean(x), shrunk[h]) for (h, _), x in paths.items()], spread)
    logit = lambda p: math.log(min(1 - 1e-4, max(1e-4, p)) / (1 - min(1 - 1e-4, max(1e-4, p))))
    out = []
    for h, p, q in rows:
        if q is None:
            out.append((None, None, 0.0))
            continue
        at_host = (sum(hosts[h]) - q + k * rate) / (len(hosts[h]) - 1 + k)
        at_path = (sum(paths[h, p]) - q + m * at_host) / (len(paths[h, p]) - 1 + m)
        out.append((at_host, at_path, 1 / (1 + math.exp(-(logit(q) + logit(at_path) - logit(rate))))))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_posteriors_by_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality_classifier, "MOST_SITES", 0)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "b", "c", None, f"rare{i}"])
        good = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.6}.get(host, 0.5)
        rows.append((i, None if i % 50 == 7 else (GOOD if good else BAD).format(i, i), host, rng.choice(["en", "de", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = fit(docs, spark.createDataFrame([(r[0], int(r[1] is not None and "story" in r[1])) for r in rows[::2]], "doc_id long, quality int"))
    got = sorted(classify(docs, model).collect(), key=lambda r: r.doc_id)
    want = posteriors([(r[2], r[3], g.doc_quality) for r, g in zip(rows, got)])
    for g, w in zip(got, want):
        assert [g.host_quality, g.path_quality, g.quality] == pytest.approx(w, abs=1e-9)
    # A document whose quality is the threshold exactly is kept, like all that tie with it.
    at = sorted(r.quality for r in got)[200]
    kept = {r.doc_id for r in classify(docs, model, threshold=at).filter("kept").collect()}
    assert kept == {r.doc_id for r in got if r.quality >= at} == {r.doc_id for r in keep_good(docs, model, threshold=at).collect()}


def test_held_out_accuracy(spark):
    """Fitted on some of the labels, right about the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = {i for i in known if zlib.crc32(str(i).encode()) % 3 == 0}
    model = fit(docs, labels.filter(~labels.doc_id.isin(list(held))))
    found = {r.doc_id: r.kept for r in classify(docs, model).collect()}
    right = [found[i] == bool(known[i]) for i in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.9


def test_very_long_text(spark):
    long = "\n".join(f"the word {i} of a long story and its friends" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, "a", "en"), (2, "x" * 2_000_000, "a", "en"), (3, "short", "a", "en")], "doc_id long, text string, source string, lang string")
    got = classify(docs, Scorecard(np.empty((0, 12)), np.empty(0))).collect()
    assert len(got) == 3 and all(r.doc_quality == 0.5 and r.kept for r in got)
