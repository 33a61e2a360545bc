import zlib

import numpy as np

from sluicebox.llm import language_id
from sluicebox.llm.language_id import Part, buckets, codes, fit, identify

WORDS = {"en": "the and of that with have this from they would there their what about which when", "de": "der die und nicht werden eine auch sich über nach wieder können schön müssen", "fr": "les des est dans une pour que qui sur avec être même après où été déjà"}


def rows(n=400):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 30)), lang) for i, lang in enumerate(np.resize(list(WORDS), n).tolist())]


def test_held_out_accuracy(spark):
    data = [(i, t, lang, "x") for i, t, lang in rows()] + [(1000, None, "en", ""), (1001, "12 34 !!", "de", ""), (1002, "", None, ""), (None, "the and of that", None, ""), (3, "the and of that", "fr", ""), (1003, "der die und " * 50_000, None, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = identify(docs, fit(docs)).collect()
    assert len(got) == len(data)
    want = {i: lang for i, _, lang, _ in data if i is not None and i < 400}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id == 1003:
            assert r.lang_pred == "de"
    mistakes = [r for r in got if r.held_out and r.doc_id in want and r.lang_pred != want[r.doc_id]]
    assert not mistakes
    # Labels of held-out rows, and everything but the text, make no difference.
    blind = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(doc_id AS string)), 4) = 2, 'xx', lang) AS lang")
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 9))
    assert sorted(map(key, identify(blind, fit(blind)).collect())) == sorted(map(key, got))
    nothing = fit(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), fit(docs.limit(0))).collect() == []


def test_against_plain_bayes(monkeypatch):
    data = rows(60)
    names = sorted(WORDS)
    counts = np.zeros((3, 1 << 10))
    for _, t, lang in data[:30]:
        np.add.at(counts[names.index(lang)], buckets(codes(t), (1, 2), 10), 1)
    part = Part(names, counts, np.log([1 / 3] * 3), (1, 2), 10)
    logp = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
    texts = [t for _, t, _ in data[30:]] + [None, "12", "é", data[0][1] * 40]
    for size in (1 << 22, 3000, 30):  # batches cut into many slices have the same totals
        monkeypatch.setattr(language_id, "SLICE", size)
        got = part.totals(texts)
        for row, t in zip(got, texts):
            if not len(codes(t)):
                assert (row == -np.inf).all()
                continue
            want = np.array([sum(logp[k][b] for b in buckets(codes(t), (1, 2), 10)) for k in range(3)]) + np.log(1 / 3)
            assert np.allclose(row, want, atol=1e-9) and (row == part.totals([t])[0]).all()


def test_parts_of_languages(spark, monkeypatch):
    """A matrix too large to be sent whole goes language by language; ties go to the first by code point."""
    data = [(i, t, lang) for i, t, lang in rows(120)] + [(500 + i, t, f"{lang}2") for i, t, lang in rows(120)] + [(1000, None, "en"), (1001, "12", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    # Equal documents for two names of each language, so that they tie.
    docs = docs.unionByName(docs.filter("lang like '__2'").selectExpr("doc_id + 5000 AS doc_id", "text", "left(lang, 2) AS lang")).filter("pmod(crc32(cast(doc_id AS string)), 4) <> 2")
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 9))
    whole = sorted(map(key, identify(docs, fit(docs)).collect()))
    monkeypatch.setattr(language_id, "MOST_BYTES", 8 << 16)
    monkeypatch.setattr(language_id, "MOST_IDS", 0)
    assert sorted(map(key, identify(docs, fit(docs)).collect())) == whole and len({r[1] for r in whole}) > 2
    same = np.ones((2, 1 << 10))
    assert Part(["a", "b"], same, np.log([0.5, 0.5]), (1, 2), 10).totals(["words"]).argmax(axis=1).tolist() == [0]


def test_codes():
    assert "".join(map(chr, codes("Ab, 1-É!"))) == " ab é "
    assert len(codes("123")) == len(codes(None)) == len(codes("")) == 0
