import re
from collections import Counter

import numpy as np
import pytest

from sluicebox.llm import mixing
from sluicebox.llm.mixing import layers, mix, permuted, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257, 1000])
def test_permutation(size):
    i = np.arange(size)
    a, b = (permuted(i, np.full(size, size), np.full(size, key, np.uint64)) for key in (5, 6))
    assert sorted(a) == sorted(b) == list(range(size))
    assert size < 10 or list(a) != list(b)


def test_targets():
    assert targets([100, 100], [1, 1], 3) == [100, 100]
    assert targets([10, 190], [1, 1], 3) == [30, 170]
    assert targets([0, 5], [1, 1], 3) == [0, 5]
    assert targets([], [], 3) == []
    got = targets([1, 1, 998], [3, 2, 1], 3)
    assert got == [3, 3, 994]


def test_layers():
    runs = [{"word": 0, "n": 2, "times": 2, "part": 0}, {"word": 2, "n": 2, "times": 1, "part": 1}]
    assert list(layers("a b\n c  d", 4, runs)) == ["a b\n c  d", "a b c"]
    assert list(layers("a b", 2, [{"word": 0, "n": 2, "times": 0, "part": 0}])) == []


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 200))), [None, "a", "b", "hot", "hot"][i % 5], "x") for i in range(400)]
    return out + [(1000, None, "a", "x"), (1001, "", "empty", "x"), (None, "no id", "b", "x"), (7, out[7][1], out[7][2], "x"), (1002, "word " * 30_000, "long", "x")]


def test_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    made = mix(docs, block=16, shard=32)
    got = made.taken().collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        source, text = by_id[r.doc_id][2], by_id[r.doc_id][1]
        assert r["size"] == len(WORD.findall(text or "")) and r.taken <= 3 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, targets([sizes[n] for n in names], [1.0 + i % 3 for i in range(len(names))], 3)))
    assert {n: round(t, 6) for n, t in want.items()} == {n: round(t, 6) for n, t in target.items()}
    assert all(abs(taken[n] - want[n]) <= 16 for n in names)
    again = mix(docs.repartition(7), block=16, shard=32).taken().collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    shards = Counter(r.shard for r in made.slots.collect())
    assert max(shards.values()) <= 32 or max(shards, key=shards.get) == max(shards)

    texts = made.documents()
    assert texts.columns == docs.columns
    words = Counter()
    for r in texts.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(by_id[r.doc_id][1]))
    total = Counter()
    for r in got:
        total[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in total.items() if v})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).taken().collect() == [] and mix(docs).documents().collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
        monkeypatch.setattr(mixing, "RUN", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [None, "a", "b", "hot", "hot", "hot"][i % 6], int(rng.integers(0, 90))) for i in range(240)] + [(999, "tiny", 3)]
    docs = spark.createDataFrame([(i, "w " * n if n or i % 2 else None, s) for i, s, n in rows], "doc_id long, text string, source string")
    made = mix(docs, block=16, shard=8)
    got = {r.doc_id: r for r in made.taken().collect()}
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, targets([sizes[n] for n in names], [1.0 + i % 3 for i in range(len(names))], 3)))
    assert all(got[i].target == want[s] and got[i].source_size == sizes[s] and got[i]["size"] == n for i, s, n in rows)
    # Blocks: every document's taken words, from its place and the permutations, one slot after the other.
    places = {r.id: r for r in made.rows.collect()}
    for sid, source in enumerate(names):
        own = sorted((places[i].start, n, i) for i, s, n in rows if s == source and n)
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
        stream = [i for _, n, i in own for _ in range(n)]
        count, words = -(-len(stream) // 16), min(round(want[source]), 3 * len(stream))
        full, rest = divmod(words, len(stream)) if stream else (0, 0)
        taken = Counter({i: n * full for _, n, i in own})
        slots = -(-rest // 16)
        for j in range(slots):
            key = (1 << 48) ^ (sid << 16) ^ full
            at = int(permuted(np.array([j]), np.array([count]), np.array([key], np.uint64))[0]) * 16
            taken.update(stream[at : at + 16][: (rest - 1) % 16 + 1 if j == slots - 1 else 16])
        assert {i: got[i].taken for _, _, i in own} == {i: taken[i] for _, _, i in own}
    counts = Counter(r.shard for r in made.slots.collect())
    total = sum(counts.values())
    assert total == sum(r.slots for r in made.table.collect()) and max(v for k, v in counts.items() if k < -(-total // 8)) <= 8


def test_very_many_sources(spark, monkeypatch):
    """Sources beyond the bound are mixed like others."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 5 + 1 AS int)) AS text", "concat('host', id % 20000) AS source")
    monkeypatch.setattr(mixing, "MOST_SOURCES", 10_000)
    there = mix(docs).taken()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 30_000)
    key = lambda r: (r.doc_id, r["size"], r.source_size, round(r.target, 9), r.taken)
    rows = sorted(map(key, there.collect()))
    assert rows == sorted(map(key, mix(docs).taken().collect())) and len(rows) == 30_000
    assert abs(sum(r[4] for r in rows) - sum(r[1] for r in rows)) < 20_000
