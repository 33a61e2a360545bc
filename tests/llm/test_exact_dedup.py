import hashlib
import re
from collections import defaultdict

from sluicebox.llm import exact_dedup
from sluicebox.llm.bloom import possibly_repeated
from sluicebox.llm.common import park
from sluicebox.llm.exact_dedup import drop_copies, exact_groups

ROWS = [(1, "a b"), (1, "a b"), (2, "ab"), (3, None), (4, " "), (5, ""), (None, "q"), (6, "q"), (1, "zz"), (7, "zz "), (9, "solo"), (10, "a b"), (11, "a b"), (12, "x" * 50_000), (13, "x " * 50_000), (None, None)]
ROWS += [(100 + i, "hot copy") for i in range(500)]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        for n, m in enumerate(sorted(members)):
            out.append((str(m[3]), str(best[3]), len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, True) for r in ROWS], "doc_id long, text string, kept boolean")
    for bits, most in ((1, 1 << 28), (16, 1 << 28), (512, 1 << 16), (1, 64)):  # small filters and several ranges change nothing
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, bits_per_row=bits, max_bits=most).collect())
        assert got == brute(ROWS)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in left.collect()) == sorted((i, n) for i, n in ((str(r[0]), len(r[1] or "")) for r in _kept()))
    monkeypatch.setattr(exact_dedup, "MOST_DROPPED", 0)
    far = drop_copies(docs)
    assert far.columns == docs.columns and sorted(map(str, far.collect())) == sorted(map(str, left.collect()))
    assert exact_groups(docs.limit(0)).collect() == [] and drop_copies(docs.limit(0)).collect() == []


def _kept():
    groups = {}
    for i, t in ROWS:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        rank = (-len(t or ""), i is None, i or 0)
        if key not in groups or rank < groups[key][0]:
            groups[key] = (rank, (i, t))
    return [r for _, r in groups.values()]


def test_only_possible_copies_shuffle(spark):
    """Rows without a twin reach the result without an exchange of theirs."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    plan = exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Union")[1].split(":-")[1] if ":-" in plan else plan
    assert "Exchange hashpartitioning" not in first


def test_ranges(spark):
    """A filter that outgrows what is sent at once is tested range by range, and marks all that repeat."""
    rows = spark.range(4000).selectExpr("id", "xxhash64(id % 3900) AS h", "id AS maybe_not")
    got = possibly_repeated(park(rows, "x"), "h", bits_per_row=64, max_bits=1 << 16).collect()
    marked = {r.id for r in got if r.maybe}
    assert len(got) == 4000 and {*range(100), *range(3900, 4000)} <= marked and len(marked) < 400
