"""Exact deduplication by two passes and a Bloom filter of repeated hashes. [native]

Pass one reads the texts once and parks (id, length, hash). Every hash sets one of the filter's positions; those set
twice or more make up the filter of possibly repeated hashes, kept as 4 KB bitmaps. Pass two tests each row against
those bitmaps, which go to all executors. Rows that miss pass straight through as groups of one; only the others
shuffle, without their texts. A false positive of the filter costs a shuffled row and never changes a result.

The filter grows with the rows. What is sent at once does not: hashes are split into as many ranges as keep a range's
filter at max_bits / 8 bytes, and the ranges are tested one after another, each reading its own files only.

To find the positions that are set twice, each row's position (one number of four bytes or so, neither its hash nor
its id) goes through an exchange. Bitmaps can be merged by aggregation without it, but then tell no longer which
positions two rows have set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.bloom import BITS_PER_ROW, MAX_BITS, among, apart, possibly_repeated
from sluicebox.llm.common import MOST_IDS, SPACES, fresh, park

def normalised(text: Column) -> Column:
    """Without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, text_length.

    Texts are equal when they are identical without white space; a null text is an empty one, and all empty
    texts are equal. Of equal texts the longest original (code points) stays, then the smallest id, nulls last.
    Rows that repeat id and length within a group count each, and the first of them stays. An empty table gives
    no rows. Other columns of docs are not read.
    """
    sha = F.sha2(normalised(F.col(text_col)), 256)
    slim = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), F.unhex(sha).alias("sha"))
    slim = park(slim.withColumn("h", F.xxhash64("sha")), "hashes")
    tested = possibly_repeated(slim, "h", bits_per_row, max_bits)
    single = tested.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "n")
    rows = park(tested.filter("maybe").groupBy("sha", "id", "n").agg(F.count("*").alias("copies")), "possible")
    best = rows.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best"), F.sum("copies").alias("group_size"))
    best = park(best.select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"), "group_size"), "groups")
    # A written table on each side: the exchange of a hot text's rows is one that adaptive execution splits.
    shared = rows.join(best, "sha").select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("best"), "sha", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    shared = shared.select("id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "sha", "n")
    return single.unionByName(shared).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.col("n").alias("text_length"))


#: Most dropped keys (a hash as text among them) that are broadcast.
MOST_DROPPED = MOST_IDS // 4


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows pass without a shuffle while the dropped keys are few
    enough to broadcast, and beyond that unless a filter takes them for dropped ones. A row is known by its id, length
    and hash, so repeated ids do no harm; of rows that repeat all three, one stays."""
    name, size, sha, stays, rows = fresh(docs, "_id", "_len", "_sha", "_stays", "_rows")
    verdicts = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    keys = verdicts.groupBy(F.col(id_col).alias(name), F.col("text_length").alias(size), F.col("text_sha256").alias(sha))
    keys = park(keys.agg(F.max("kept").alias(stays), F.count("*").alias(rows)), "verdicts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    here = {name: F.col(id_col), size: F.length(text), sha: F.sha2(normalised(text), 256)}
    off = keys.filter(~F.col(stays) | (F.col(rows) > 1)).select(name, size, sha)
    plain = apart(docs, off, here, MOST_DROPPED)
    again = keys.filter(F.col(stays) & (F.col(rows) > 1)).select(name, size, sha)
    if again.isEmpty():
        return plain
    return plain.unionByName(among(docs, again, here, MOST_DROPPED).dropDuplicates([name, size, sha]).select(docs.columns))
