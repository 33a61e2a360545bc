"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.storage import park, spread

__all__ = ["MOST_IDS", "SPACES", "WORD", "batches_of", "fresh", "let", "park", "small_batches", "spread", "word_count"]

#: Most keys of a few numbers that are sent to every executor, some 50 MB as a hash relation; beyond it joins shuffle.
MOST_IDS = 500_000
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, whatever the optimizer makes of the projections around it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has a column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to so many rows and 16 MB at most. The JVM and the Python worker of a task
    both hold a batch whole, several times over while it is converted, and rows of whole texts are large."""
    before = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(rows if before <= 0 else min(rows, before)))
    spark.conf.set(_BYTES, "16m")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """The same with fewer rows for what is parked inside, whose rows are larger still."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
