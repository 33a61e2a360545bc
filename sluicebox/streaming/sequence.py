"""Sequence deduplication over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluicebox.operators.sequence import Queue


def stream_fifo_dedup(hashes: DataFrame, key: str, order: str, hash_col: str, threshold: int = 14, most: int = 10) -> DataFrame:
    """The retained rows (key, order, hash) of a stream, as fifo_dedup has them, if each key arrives in order.

    The state of a key is its queue and the last position seen; a row that comes late, at or before that position,
    is rejected, since taking it would change what was decided after it. Rows without a hash are skipped, and those
    without a key are one sequence. A task holds one key's narrow rows of one micro-batch, which the source's options
    (files or bytes per trigger) bound.
    """
    rows = hashes.select(key, order, hash_col).filter(F.col(hash_col).isNotNull())
    state = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("last", rows.schema[order].dataType)])

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        hashes, last = held.get if held.exists else ([], None)
        queue = Queue(threshold, most, hashes)
        arrived = pd.concat(list(parts)).sort_values(order, kind="stable")
        keep = []
        for at, value in zip(arrived[order], arrived[hash_col]):
            late = last is not None and at <= last
            keep.append(not late and queue.takes(int(value)))
            last = at if not late else last
        held.update(([int(h) for h in queue.hashes], last.item() if hasattr(last, "item") else last))
        yield arrived[keep]

    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, state, "append", GroupStateTimeout.NoTimeout)
