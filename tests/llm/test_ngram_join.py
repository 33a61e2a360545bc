import random
import re

import pytest

from sluicebox.llm.graph import components
import sluicebox.llm.ngram_join as ngram_module
from sluicebox.llm.ngram_join import ngram_join, overlap_bound, shingles, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, num, den):
    """id -> (size, smallest id reachable)"""
    found = [(i, sets(t, k)) for i, t in rows]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, p) in enumerate(found):
        for b in range(a):
            q = found[b][1]
            if p and q and den * len(p & q) >= num * len(p | q):
                root[find(a)] = find(b)
    low = {}
    for x, (i, _) in enumerate(found):
        low.setdefault(find(x), []).append(i)
    best = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted((str(i), len(s), str(best[find(x)])) for x, (i, s) in enumerate(found))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    out = [(i, " ".join(rng.choices(words, k=rng.randint(1, 150)))) for i in range(150)]
    out += [(200 + i, " ".join(rng.choices(words, k=30) + passage)) for i in range(60)]  # one passage in many
    base = rng.choices(words, k=120)
    for i in range(120):  # near copies of one text, some of them only of each other
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
        out.append((1000 + i, " ".join(copy)))
    chain = rng.choices(words, k=200)
    for i in range(30):  # a chain whose ends don't link
        out.append((2000 - i, " ".join(chain[i * 3 :] + [f"c{j}" for j in range(i * 3)])))
    out += [(3000 + i, "The QUICK fox\tÉ") for i in range(40)] + [(3100, "the quick FOX é"), (3101, "the quick fox É  ")]
    out += [(4000, None), (4001, ""), (4002, " \n\t"), (4003, None), (None, "one two"), (4005, "one\x0btwo"), (4005, "one two"), (4006, " "), (4007, "w " * 20_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 1, 2)])
def test_against_brute_force(spark, rows, k, num, den):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    join = ngram_join(docs, k=k, num=num, den=den)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join.groups().collect())
    assert got == brute(rows, k, num, den)
    kept = join.first_of_each().collect()
    assert len(kept) == join.groups().filter("leads").count()
    assert len({r[2] for r in got if r[1]}) + sum(not r[1] for r in got) == len(kept)


def test_far_side_of_the_bounds(spark, rows, monkeypatch):
    """Nothing broadcast, and filters too small: the same groups, and the same rows stay."""
    for name in ("MOST_IDS", "MOST_SIGNED", "MOST_NODES", "MOST_COMMON"):
        monkeypatch.setattr(ngram_module, name, 0)
    monkeypatch.setattr(ngram_module, "MOST_BITS", 1 << 15)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    join = ngram_join(docs, k=4, num=85, den=100)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join.groups().collect())
    assert got == brute(rows, 4, 85, 100)
    kept = join.first_of_each()
    assert kept.columns == docs.columns and kept.count() == join.groups().filter("leads").count()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join(docs).groups().collect() == [] and ngram_join(docs).first_of_each().collect() == []


def test_shingles():
    assert len(shingles("a b c d e", 4)) == 2 and len(shingles("a b", 4)) == 1 and len(shingles(None, 4)) == 0
    assert (shingles("A b C d", 4) == shingles("a\nB  c D", 4)).all()


def test_signature_bounds_overlap():
    rng = random.Random(9)
    for _ in range(200):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 400))]
        p = shingles(" ".join(words[: rng.randint(1, len(words))]), 3)
        q = shingles(" ".join(words[rng.randrange(len(words)) :]), 3)
        assert len(p) >= overlap_bound(len(p), signature(p), len(q), signature(q)) >= len(set(p) & set(q))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
