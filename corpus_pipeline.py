"""From raw documents to token ids: reject poor documents, drop copies and near copies, mix sources, encode.

Every stage reads the whole table that its predecessor kept, and all but the last return the columns of documents.
Rows that repeat, in whole or in their ids, count each, columns beside doc_id, text, source, lang and n_chars pass
through whatever their names, and an empty table gives an empty one. What each stage does with nulls is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import quality_classifier
from sluicebox.llm.byte_bpe import encode_decode
from sluicebox.llm.common import park, spread
from sluicebox.llm.exact_dedup import drop_copies
from sluicebox.llm.mixing import mix
from sluicebox.llm.ngram_join import ngram_join
from sluicebox.session import table
from sluicebox.storage import drop


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, keeps: quality 0.5 and above. Null, empty and
    blank texts have quality 0 and go. Null sources and languages are sites like others. Without labels, all texts with
    words stay."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the one with the
    smallest id, nulls last, then any one row. A null text counts as an empty one."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link with similarity 0.8 or more: that with the smallest id,
    nulls last. Null texts and those without words are groups of their own and stay."""
    return ngram_join(docs, k=5, num=80, den=100).first_of_each()


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the shares that their sources' weights give; a document taken twice is two rows. Null sources
    are one source, the last. Null texts and those without words have nothing to take and give no row."""
    return mix(docs).documents().withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digest of the decoded bytes, one row per
    row. A null text has no tokens."""
    found = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mixing), ("byte_bpe", encode)]

#: A fitted classifier, seeded draws and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's table is written before the next begins and deleted once that has written
    its own; the last one's rows are computed from what is left."""
    docs = spread(table(spark, sf_dir, "documents"))
    for at, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, park(stage(spark, docs, sf_dir), name)
        if at:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
