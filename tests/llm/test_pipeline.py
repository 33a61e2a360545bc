"""Every stage of the pipeline against a plain version of it, on the smallest tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from sluicebox.llm.byte_bpe import Codec
from sluicebox.llm.common import park
from sluicebox.llm.mixing import targets
from test_byte_bpe import PATH
from test_ngram_join import sets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Rows that repeat, clash or lack everything go along.
    docs = docs.unionByName(spark.createDataFrame([(0, None, None, None, None), (10_000, " ", "en", "src0", 1), (10_001, None, None, "x", 0)], docs.schema)).unionByName(docs.limit(3))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(park(stage(spark, out[-1], SF), name))
    return [sorted(x.collect(), key=str) for x in out]


def test_quality(spark, stages):
    before, after = stages[0], stages[1]
    assert stages[0] and {r.doc_id for r in after} < {r.doc_id for r in before}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    right = [labels[i] == (i in kept) for i in labels]
    assert sum(right) / len(right) > 0.9 and all(r.text and r.text.strip() for r in after)


def test_exact(stages):
    best = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        rank = (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, (rank, r)), (rank, r), key=lambda x: x[0])
    assert sorted((r for _, r in best.values()), key=str) == stages[2]


def test_near(stages):
    rows = [(r, sets(r.text, 5)) for r in sorted(stages[2], key=lambda r: r.doc_id)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            p, q = rows[a][1], rows[b][1]
            if 100 * len(p & q) >= 80 * len(p | q) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert sorted((rows[g][0] for g in set(group)), key=str) == stages[3]


def test_mixing(stages):
    before, after = stages[3], stages[4]
    size, got = Counter(), Counter()
    for r in before:
        size[r.source] += len(WORD.findall(r.text))
    for r in after:
        got[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    names = sorted(size)
    for name, want in zip(names, targets([size[n] for n in names], [1 + i % 3 for i in range(len(names))], 3)):
        assert abs(got[name] - want) <= 256
    assert max(Counter(r.doc_id for r in after).values()) <= 4


def test_encode(stages):
    codec = Codec(PATH)
    texts = Counter((r.doc_id, codec.encode(r.text).tobytes()) for r in stages[4])
    assert texts == Counter((r.doc_id, bytes(r.ids)) for r in stages[5])


def test_run(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, SF).count() > 0
