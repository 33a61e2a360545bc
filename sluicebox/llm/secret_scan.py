"""Secret scanning with an incremental blob ledger. [native]

Every version of a path is addressed by the SHA-256 of its text. The ledger holds pairs of a blob and a rule version,
with the spans found; a row of it lists all pairs of one blob that were scanned together. Only pairs that the ledger
doesn't hold are scanned, once per blob however many paths and versions carry it, and the findings of a blob are
joined back to all of its paths. A rule that changes is scanned alone.

Filters of bounded size hold the blobs that several versions carry or that the ledger knows, and those of them that
have pairs to scan. Texts that miss the first are scanned where they are read with all rules; of the others only those
that pass the second are joined with the one path that stands for their blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.bloom import MAX_BITS, among, filter_bits, filter_of, possibly_repeated, probed
from sluicebox.llm.common import let, park

#: Most blobs whose paths are broadcast, some 20 MB; beyond it texts that a filter takes for theirs shuffle to them.
MOST_BLOBS = 100_000
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"
_LEDGER = f"blob binary, rules array<string>, found {_FOUND}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; one stays if it has at least `least` characters
    in the given group. `version` changes whenever the pattern does, so that old blobs are scanned again.
    `needs`, where given, is a string that every match holds: texts without it are not searched."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    needs: str = ""


#: Base rules first; the order is that in which spans with the same start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is long enough is the whole of its match, so the length can stand in the pattern here.
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
)
BASE = ("assign", "access", "hex")


def rule_versions(rules: tuple[Rule, ...]) -> list[str]:
    """Names the rules and their versions, in order."""
    return [f"{r.kind}:{r.version}" for r in rules]


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of a rule's matches in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def place(found: Column) -> Column:
        # The gaps around the matches and the matches themselves make up the text, so running lengths place them.
        gaps = F.split(text, rule.pattern, -1)
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        zero = F.struct(F.lit(0).alias("at"), none.alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("all"))
        return F.aggregate(lengths, zero, step, lambda acc: acc["all"])

    def placed(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(place(found))

    out = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    if rule.least:
        worth = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
        kept = F.filter(F.arrays_zip(out.alias("span"), worth.alias("worth")), lambda x: x["worth"])
        out = F.when(F.size(out) == 0, none).otherwise(F.transform(kept, lambda x: x["span"]))
    return F.when(F.contains(text, F.lit(rule.needs)), out).otherwise(none) if rule.needs else out


def _listed(rules: tuple[Rule, ...], names: dict[str, Column], kinds: tuple[str, ...]) -> Column:
    """array<struct<start,rank,end,kind>> over the kinds, by start and then as the rules are listed."""
    def ranked(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    parts = [F.transform(names[r.kind], ranked(k, r.kind)) for k, r in enumerate(rules) if r.kind in kinds]
    return F.array_sort(F.concat(*parts))


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob) of every row; null texts are empty."""
    return docs.select(F.col(path_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))


def _known(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, found) of the ledger's rows, as far as they are about these rules; ranks are those of now."""
    now = F.array(*[F.lit(x) for x in rule_versions(rules)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    held = ledger.select("blob", F.array_intersect("rules", now).alias("rules"), "found").filter(F.size("rules") > 0)
    named = F.transform("rules", lambda x: F.substring_index(x, ":", 1))
    mine = F.filter("found", lambda x: F.array_contains(named, x["kind"]))
    ranked = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), (F.array_position(kinds, x["kind"]) - 1).cast("int").alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return held.select("blob", "rules", ranked.cast(_FOUND).alias("found"))


def _findings(seen: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, blob, found) of every version, from all rows of the ledger about its blob."""
    hits = ledger.filter(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return seen.join(park(hits, "hits"), "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    findings: one row per row of docs, as path, blob, and `found`, the array of (start, rank, end, kind) in order.
    New ledger rows: blob, rules (kind:version of each) and found, for the pairs that the ledger (same columns, None:
    empty) didn't hold; append them to it. Null texts are empty, repeated rows count each, and an empty table gives no
    rows. Other columns are not read.
    """
    every = F.array(*[F.lit(x) for x in rule_versions(rules)])
    seen = park(versions(docs, path_col, text_col).withColumn("h", F.xxhash64("blob")), "versions")
    known = None if ledger is None else _known(ledger, rules)
    if known is not None:
        whole = known.filter(F.size("rules") == len(rules)).select("blob")
        if seen.select("blob").distinct().join(whole, "blob", "left_anti").isEmpty():
            # Nothing to scan, so no text is read.
            return _findings(seen, known), docs.sparkSession.createDataFrame([], _LEDGER)
    # Blobs of several versions, and those that the ledger knows: the others are scanned as they are met.
    several = possibly_repeated(seen, "h").filter("maybe").groupBy("blob", "h").agg(F.count("*").alias("n")).filter("n > 1").select("blob", "h")
    if known is not None:
        # Distinct first: a blob that very many paths carry is one row in the join.
        several = several.unionByName(seen.select("blob", "h").distinct().join(known.select("blob"), "blob", "left_semi")).distinct()
    several = park(several, "several")
    bits = filter_bits(several.count(), max_bits=MAX_BITS)
    maps = park(filter_of(several, "h", bits), "filter")
    apart = probed(seen, F.col("h"), maps, bits)
    unseen = apart.filter("maybe").groupBy("blob").agg(F.min("path").alias("path"))
    if known is None:
        unseen = unseen.withColumn("missing", every)
    else:
        held = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("held"))
        unseen = unseen.join(held, "blob", "left").withColumn("missing", F.array_except(every, F.coalesce("held", F.array().cast("array<string>")))).filter(F.size("missing") > 0).drop("held")
    unseen = park(unseen, "unseen")

    def scanned(rows: DataFrame) -> DataFrame:
        """rows (blob, missing, _text) as rows of the ledger."""
        wanted = lambda r, found: F.when(F.array_contains("missing", f"{r.kind}:{r.version}"), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        names = {r.kind: F.col(f"_{r.kind}") for r in rules}
        rows = rows.select("blob", "missing", *[wanted(r, spans(F.col("_text"), r)).alias(f"_{r.kind}") for r in rules])
        return rows.select("blob", F.col("missing").alias("rules"), _listed(rules, names, tuple(names)).cast(_FOUND).alias("found"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(path_col).alias("_path"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_blob"))
    texts = probed(texts, F.xxhash64("_blob"), maps, bits)
    alone = texts.filter("not maybe").select(F.col("_blob").alias("blob"), every.alias("missing"), "_text")
    # One path stands for each of the others. A path with several versions is told apart by the address itself.
    first = among(texts.filter("maybe"), unseen, {"path": F.col("_path"), "blob": F.col("_blob")}, MOST_BLOBS).select("blob", "missing", "_text")
    # A row that repeats path and text is scanned with its twin; pairs stay unique in the ledger.
    new = park(scanned(alone).unionByName(scanned(first).groupBy("blob", "rules").agg(F.first("found").alias("found"))), "ledger")
    return _findings(seen, new if known is None else new.unionByName(known)), new


def as_text(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    chosen = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

