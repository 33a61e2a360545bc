import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebox.llm import pii
from sluicebox.llm.pii import KINDS, pseudonymise

ROWS = [
    (1, "Mail un.34@mail7.example.com or UN.34@MAIL7.EXAMPLE.COM now.", "x"),
    (2, "call +1 (017) 555-7713 or +10175557713, not 12345", "x"),
    (3, "card 4417744280351547, 4417-7442-8035-1547 and no card 9807915762804490", "x"),
    (4, "host 97.51.17.173 but 1.2.3.4.5 and 300.1.1.1 stay", "x"),
    (5, None, None),
    (6, "", ""),
    (None, "Mrs. Anna Schmidt met Mr. Anna Schmidt and Frau Anna Schmidt; Г-н Иванов came. 078-05-1120", "x"),
    (1, "Mail un.34@mail7.example.com or UN.34@MAIL7.EXAMPLE.COM now.", "x"),
    (8, "plain words only", "x"),
    (9, "a.b@x.example.com " * 2000, "x"),
]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_surrogates(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_email string")
    got = pseudonymise(docs, "k").collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[5].text is None and by[6].text == "" and by[8].text == "plain words only" and by[8].n_entities == 0
    first, second = re.findall(r"\S+@\S+", by[1].text)
    assert first.upper() == second and first != "un.34@mail7.example.com" and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", first)
    a, b = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1\d{10}), not 12345", by[2].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    c, d = re.fullmatch(r"card (4\d{15}), (4\d{3}-\d{4}-\d{4}-\d{4}) and no card 9807915762804490", by[3].text).groups()
    assert c == d.replace("-", "") != "4417744280351547" and luhn(c)
    assert re.fullmatch(r"host (?!97\.51\.17\.173)\d+\.\d+\.\d+\.\d+ but 1\.2\.3\.4\.5 and 300\.1\.1\.1 stay", by[4].text)
    she, he, again, him, ssn = re.fullmatch(r"Mrs\. (\w+ \w+) met Mr\. (\w+ \w+) and Frau (\w+ \w+); Г-н ([Ѐ-ӿ]+) came\. (9\d\d-\d\d-\d{4})", by[None].text).groups()
    assert she == again != he and "Schmidt" not in by[None].text and him != "Иванов"
    assert len(set(by[9].text.split())) == 1 and by[9].n_email == 2000
    assert [sum(r[f"n_{k}"] for r in got) for k in KINDS] == [2004, 2, 1, 1, 2, 4]
    assert sorted(map(str, got)) == sorted(map(str, pseudonymise(docs.repartition(3), "k").collect()))
    assert {r.text for r in pseudonymise(docs, "other").collect() if r.doc_id == 3} != {by[3].text}
    assert pseudonymise(docs.limit(0), "k").collect() == []


def test_distinct(spark):
    """One-letter mailboxes have 26 surrogates of their shape; the collision check finds others for the rest."""
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)}@h.example.org {chr(97 + i % 26)}{i // 26}@h.example.org") for i in range(26 * 10)], "doc_id long, text string")
    got = [re.findall(r"\S+@\S+", r.text) for r in sorted(pseudonymise(docs, "k").collect(), key=lambda r: r.doc_id)]
    real = [r.text.split() for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    pairs = {(x, y) for a, b in zip(real, got) for x, y in zip(a, b)}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    assert not {x for x, _ in pairs} & {y for _, y in pairs}


def test_beside_digits(spark):
    """Cards and phones beside other groups of digits are found, and the others stay."""
    card, spaced, phone = "4417744280351547", "4417 7442 8035 1547", "+44 20 7946 0958"
    whole = [f"{card} 12/27", f"{card} 123", f"order 12 {card}", f"no 7 {card}", f"{spaced} 12/27"]
    whole += [f"12345 1234 {spaced} 9", f"12 {spaced} {spaced} 12", f"{card} 1.2.3.4.5", f"{phone} 12", f"{phone} {spaced} 12/27", f"id 12 {card}-{card} 5", "9807915762804490 12", "12 " * 60]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*whole, f"12 078-05-1120 {card}", f"{card} 97.51.17.173", phone])], "doc_id long, text string")
    got = [r.text for r in sorted(pseudonymise(docs, "k").collect(), key=lambda r: r.doc_id)]
    new = re.match(r"\d+", got[0])[0]
    laid = " ".join(new[k : k + 4] for k in range(0, 16, 4))
    called = got[-1]
    assert new != card and luhn(new) and re.fullmatch(r"\+44 \d\d \d{4} \d{4}", called) and called != phone
    assert got[: len(whole)] == [x.replace(card, new).replace(spaced, laid).replace(phone, called) for x in whole]
    assert re.fullmatch(rf"12 9\d\d-\d\d-\d{{4}} {new}", got[-3]) and re.fullmatch(rf"{new} (?!97\.51)\d+\.\d+\.\d+\.\d+", got[-2])


def test_more_numbers(spark):
    """Mastercard's 2-series and national phones; other numbers of their length stay."""
    stay = ["2220000000000000 2721000000000004", "2024-05-01 01-02-2024 12.345.678", "555-123-45678 5551234567 007 12 1999 2000 2001"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(["2221000000000009, 2720-9999-9999-9996", "555-123-4567 or 555.123.4567", "030 1234567, 030/123 4567", *stay])], "doc_id long, text string")
    rows = sorted(pseudonymise(docs, "k").collect(), key=lambda r: r.doc_id)
    one, two = re.fullmatch(r"(2[3-6]\d{14}), (2[3-6]\d\d-\d{4}-\d{4}-\d{4})", rows[0].text).groups()
    assert luhn(one) and luhn(two.replace("-", "")) and one != "2221000000000009" and two != "2720-9999-9999-9996"
    a, b = re.fullmatch(r"(\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4})", rows[1].text).groups()
    assert a.replace("-", ".") == b != "555.123.4567"
    a, b = re.fullmatch(r"(02\d \d{7}), (02\d/\d{3} \d{4})", rows[2].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "0301234567"
    assert [r.n_card for r in rows] == [2, 0, 0, 0, 0, 0] and [r.n_phone for r in rows] == [0, 2, 2, 0, 0, 0] and [r.text for r in rows[3:]] == stay


def test_people(spark):
    """One surrogate for a person whatever the title, with and without one; scripts stay."""
    texts = [
        "Mr John Smith met Dr John Smith. Later John Smith left, and Smith wrote. Blacksmith and Johnson stay, SMITH too.",
        "Professor John Smith, Mr Smith",
        "Ms Ελένη Παππά and Δρ Νίκος; Κυρία Ελένη Παππά",
        "Mr Արամ Պետրոսյան",
        "John Smith has no title here",
        "Dr Kim Rossi and Mr Kim Rossi and Mrs Kim Rossi",
    ]
    rows = sorted(pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect(), key=lambda r: r.doc_id)
    got = [r.text for r in rows]
    a, b, c, d = re.fullmatch(r"Mr (\w+ \w+) met Dr (\w+ \w+)\. Later (\w+ \w+) left, and (\w+) wrote\. Blacksmith and Johnson stay, SMITH too\.", got[0]).groups()
    assert a == b == c != "John Smith" and a.split()[1] == d != "Smith" and rows[0].n_person == 4
    assert got[1] == f"Professor {a}, Mr {d}" and got[4] == texts[4]
    e, f = re.fullmatch(r"Ms ([Ά-ώ]+ [Ά-ώ]+) and Δρ Νίκος; Κυρία ([Ά-ώ]+ [Ά-ώ]+)", got[2]).groups()
    assert e == f != "Ελένη Παππά" and re.fullmatch(r"Mr [Ա-և]+ [Ա-և]+", got[3]) and got[3] != texts[3]
    n, m, w = re.fullmatch(r"Dr (\w+ \w+) and Mr (\w+ \w+) and Mrs (\w+ \w+)", got[5]).groups()
    assert len({n, m, w}) == 3


def test_addresses(spark):
    texts = ["2001:db8:0:0:0:0:a:1 is 2001:DB8::A:1, not ::1, 12:30:45, std::vector or 1:2:3:4:5:6:7:8:9", "fe80::1:2. 00:1a:2b:3c:4d:5e"]
    got = [r.text for r in sorted(pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect(), key=lambda r: r.doc_id)]
    a, b = re.fullmatch(r"((?:[0-9a-f]{1,4}:){2}0:0:0:0(?::[0-9a-f]{1,4}){2}) is ([0-9A-F:]+), not ::1, 12:30:45, std::vector or 1:2:3:4:5:6:7:8:9", got[0]).groups()
    assert a.replace(":0:0:0:0:", "::") == b.lower() != "2001:db8::a:1"
    assert re.fullmatch(r"[0-9a-f]{1,4}::[0-9a-f]{1,4}:[0-9a-f]{1,4}\. 00:1a:2b:3c:4d:5e", got[1])


def test_crowded_space(spark, monkeypatch):
    """More numbers than surrogates of their length: later attempts are longer, and all stay distinct."""
    monkeypatch.setattr(pii, "SHORT", 1)
    numbers = [f"+1 {n // 100:02} {n % 100:02} 99" for n in range(2000)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "doc_id long, text string")
    monkeypatch.setattr(pii, "_digits", lambda seed: F.lpad(F.pmod(F.xxhash64(seed), F.lit(900)).cast("string"), 128, "0"))
    got = pseudonymise(docs, "k").collect()
    assert len({re.sub(r"\D", "", r.text) for r in got}) == 2000 and not {r.text for r in got} & set(numbers)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["", "Mr ", "Mrs. ", "Dr ", "Ms "]), st.sampled_from(["Ann", "Bob"]), st.sampled_from(["Gray", "Lund", "Moss"])), min_size=1, max_size=6), min_size=1, max_size=5))
def test_coreference_by_brute_force(spark, texts):
    """Which mentions are replaced, and which share a surrogate, worked out here without the module."""
    docs = spark.createDataFrame([(i, " then ".join(f"{t}{a} {b}" for t, a, b in x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = [r.text.split(" then ") for r in sorted(pseudonymise(docs, "k").collect(), key=lambda r: r.doc_id)]
    sexes = {"Mr ": "m", "Mrs. ": "f", "Ms ": "f"}
    everywhere: dict = {}
    for x in texts:
        for t, a, b in x:
            everywhere.setdefault((a, b), set()).update({sexes[t]} if t in sexes else ())
    surrogates: dict = {}
    for x, out in zip(texts, got):
        here: dict = {}
        for t, a, b in x:
            here.setdefault((a, b), set()).update({sexes[t]} if t in sexes else ())
        for (t, a, b), new in zip(x, out):
            named = any((p, q) == (a, b) and s for s, p, q in x)
            if not t and not named:
                family = any(q == b and s for s, p, q in x)
                assert new.startswith(f"{a} ") and (new == f"{a} {b}") == (not family)
                continue
            assert new.startswith(t) and new[len(t) :] != f"{a} {b}"
            sex = sexes.get(t) or (min(here[a, b]) if len(here[a, b]) == 1 else min(everywhere[a, b]) if len(everywhere[a, b]) == 1 else "n")
            assert surrogates.setdefault((a, b, sex), new[len(t) :]) == new[len(t) :]
    assert len(set(surrogates.values())) == len(surrogates)
