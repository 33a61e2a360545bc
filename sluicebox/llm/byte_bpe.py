"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text longer than `leaf` code points is cut in halves, each half is encoded by itself, and two neighbours join by
encoding anew only a window around their border. The window grows until it begins and ends at cuts of which the
tokens outside provably don't depend: a place between a non-space and a following space or line feed. No match
of the pattern crosses such a place, since white space is only ever the first character of a match or all of it,
and a match that begins there depends on what follows alone. Without such a place the window is both halves
whole. So the joined ids are those of the whole text, however it is cut, and the join is associative.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.llm.common import small_batches

LEAF = 1 << 14
#: Rows in an output batch, which bounds what a Python worker holds besides its input batch.
ROWS = 256
_CUT_AHEAD = re.compile(r"\S(?=[ \n])")
_U4 = np.dtype("<u4")


class Codec:
    """A vocabulary file of ranks with the pattern that splits texts before its merges."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.leaf = max(1, leaf)

    def _flat(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype=_U4)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return self._encode(text, 0, len(text)) if len(text) > self.leaf else self._flat(text)

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return self._flat(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[start:end] from those of both halves."""
        a, b = _cut_before(text, start, middle), _cut_after(text, middle, end)
        window = self._flat(text[a:b])
        keep = len(left) - self._tokens_in(left[::-1], len(text[a:middle].encode()))
        skip = self._tokens_in(right, len(text[middle:b].encode()))
        return np.concatenate([left[:keep], window, right[skip:]])

    def _tokens_in(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up size bytes."""
        if not size:
            return 0
        near = 64
        while True:
            ends = np.cumsum(self.lengths[ids[:near]])
            at = int(np.searchsorted(ends, size))
            if at < len(ends) and ends[at] == size:
                return at + 1
            if at < len(ends) or near >= len(ids):
                raise AssertionError("a cut falls inside a token")
            near *= 8

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, concatenated up the same kind of tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _cut_before(text: str, start: int, middle: int) -> int:
    """The last sure cut inside (start, middle), else start."""
    at = middle
    while at > start + 1:
        at = max(text.rfind(" ", start + 1, at), text.rfind("\n", start + 1, at))
        if at < 0:
            return start
        if not text[at - 1].isspace():
            return at
    return start


def _cut_after(text: str, middle: int, end: int) -> int:
    """The first sure cut inside (middle, end), else end."""
    found = _CUT_AHEAD.search(text, middle, end)
    return found.end() if found else end


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf=leaf)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes).

    path names the vocabulary; it is opened where the tasks run, as a file of the installed tokenizers. A null or
    empty text has no ids. Strings of special tokens are ordinary text. Only id and text are read; the id passes
    through. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    names = [id_col, "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [own.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], names=names
                )

    schema = T.StructType([slim.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return slim.mapInArrow(run, schema)
