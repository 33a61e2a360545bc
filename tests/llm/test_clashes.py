"""Columns of the input that are named like an operator's own don't disturb it."""

from pyspark.sql import functions as F

from sluicebox.llm import quality_classifier
from sluicebox.llm.exact_dedup import drop_copies
from sluicebox.llm.mixing import mix
from sluicebox.llm.ngram_join import ngram_join

NAMES = "_id _hash _h _len _sha _stays _rows _n _own _copies _good _text _key id n row node copies runs size kept quality h sid start".split()


def test_clashing_names(spark):
    rows = [(i, f"some words of text number {i // 2} that are long enough to tell {i // 2}" * 3, "a" if i % 3 else None, "en") for i in range(40)]
    rows += [rows[0], (None, None, None, None), (None, "last words of all", "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for kept, want in (
        (drop_copies(docs), 22),
        (ngram_join(docs).first_of_each(), 22),
        (quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels.limit(0))), 42),
        (mix(docs).documents(), None),
    ):
        got = kept.collect()
        assert kept.columns == docs.columns and (want is None or len(got) == want)
        assert all(r[n] == f"own {n}" for r in got for n in NAMES)
    assert quality_classifier.fit(docs, labels) is not None
