r"""Chat formatting with prefix trees.

A conversation becomes `<|im_start|>role\ntext<|im_end|>\n` for each turn. Inside roles and texts a backslash is
doubled and `<|` becomes `<\|` (and a line feed inside a role `\n`), so that no text holds a marker and the escape
can be undone. Conversations that share their initial turns are merged into a prefix tree, which is written out
depth-first: shared turns stand once in the stream, every node has the position at which it stands in its
conversations, and the intervals of the stream that it attends to, those of its ancestors and its own.

Equal conversations are one leaf. The conversations below one first turn make one tree as long as they have at most
`pack` characters; larger ones are put in order of their sequences of turns, by hash, and cut into ranges of about
that many, so no task holds more (or one conversation, which is one training record and is never cut). Turns that
conversations on both sides of a cut share stand once in each range. Positions and intervals of packs count code
points, and those of tokens() count tokens.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sluicebox.llm.byte_bpe import codec
from sluicebox.llm.common import park

START, END = "<|im_start|>", "<|im_end|>\n"
PACK = 1 << 18
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_INTERVAL = "struct<start:int,end:int>"
PACKED = f"pack string, stream string, nodes array<struct<start:int,end:int,parent:int,position:int,attends:array<{_INTERVAL}>>>, loss array<{_INTERVAL}>, leaves array<struct<content:string,node:int>>"
READ = "content string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, tree_nodes long, tree_chars long"
TOKENS = f"pack string, ids array<int>, positions array<int>, nodes array<struct<start:int,end:int,attends:array<{_INTERVAL}>>>, loss array<{_INTERVAL}>, leaves array<struct<content:string,node:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn in the template, and how many characters stand before its text."""
    head = f"{START}{escape(role)}\n" if "\n" not in role else START + escape(role).replace("\n", "\\n") + "\n"
    return f"{head}{escape(text)}{END}", len(head)


def build(conversations: list[tuple[str, list[tuple[str, str]]]]) -> dict:
    """The tree of (content, turns) pairs as stream, nodes, loss and leaves."""
    stream, nodes, loss, leaves, at = [], [], [], [], 0
    path: list[tuple[tuple[str, str], int]] = []  # turns and nodes of the conversation before
    for content, turns in sorted(conversations, key=lambda c: (c[1], c[0])):
        shared = 0
        while shared < min(len(path), len(turns)) and path[shared][0] == turns[shared]:
            shared += 1
        del path[shared:]
        for role, text in turns[shared:]:
            whole, before = format_turn(role, text)
            parent = path[-1][1] if path else -1
            end, attends = at + len(whole), list(nodes[parent]["attends"]) if path else []
            if attends and attends[-1]["end"] == at:
                attends[-1] = {"start": attends[-1]["start"], "end": end}
            else:
                attends.append({"start": at, "end": end})
            position = nodes[parent]["position"] + nodes[parent]["end"] - nodes[parent]["start"] if path else 0
            nodes.append({"start": at, "end": end, "parent": parent, "position": position, "attends": attends})
            if role == "assistant":
                loss.append({"start": at + before, "end": end - len(END)})
            stream.append(whole)
            path.append(((role, text), len(nodes) - 1))
            at = end
        leaves.append({"content": content, "node": path[-1][1] if path else -1})
    return {"stream": "".join(stream), "nodes": nodes, "loss": loss, "leaves": leaves}


def read_back(packed: dict) -> Iterator[tuple]:
    """For each leaf its content, the turns read from the stream, the texts under the loss mask, and how long the
    formatted conversation is."""
    stream, nodes = packed["stream"], packed["nodes"]
    loss = [(x["start"], x["end"]) for x in packed["loss"]]
    for leaf in packed["leaves"]:
        parts = [(a["start"], a["end"]) for a in nodes[leaf["node"]]["attends"]] if leaf["node"] >= 0 else []
        text = "".join(stream[a:b] for a, b in parts)
        turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
        under = [unescape(stream[x:y]) for a, b in parts for x, y in _inside(loss, a, b)]
        yield leaf["content"], turns, under, len(text)


def tokenised(packed: dict, encode: Callable[[str], Iterable[int]]) -> dict:
    """ids, positions, nodes and loss of a tree in tokens. A node's head, text and end are encoded one by one, so that
    the loss mask lies on tokens of texts alone."""
    stream, loss = packed["stream"], [(x["start"], x["end"]) for x in packed["loss"]]
    ids, positions, nodes, masked = [], [], [], []
    for node in packed["nodes"]:
        before, first = nodes[node["parent"]] if node["parent"] >= 0 else None, len(ids)
        under = _inside(loss, node["start"], node["end"])
        cuts = [node["start"], *(x for span in under for x in span), node["end"]]
        for a, b in zip(cuts, cuts[1:]):
            at = len(ids)
            ids.extend(map(int, encode(stream[a:b])))
            if (a, b) in under and len(ids) > at:
                masked.append({"start": at, "end": len(ids)})
        depth = before["depth"] if before else 0
        positions.extend(range(depth, depth + len(ids) - first))
        attends = list(before["attends"]) if before else []
        if attends and attends[-1]["end"] == first:
            attends[-1] = {"start": attends[-1]["start"], "end": len(ids)}
        else:
            attends.append({"start": first, "end": len(ids)})
        nodes.append({"start": first, "end": len(ids), "attends": attends, "depth": depth + len(ids) - first})
    return {"ids": ids, "positions": positions, "nodes": [{k: n[k] for k in ("start", "end", "attends")} for n in nodes], "loss": masked}


def _inside(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    return spans[bisect_left(spans, (start, 0)) : bisect_left(spans, (end, 0))]


def _turns(role_col: str, text_col: str, order: list[Column]) -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = F.sort_array(F.collect_list(F.struct(*order, role.alias("role"), text.alias("text"))))
    return F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


class Chats:
    """The formatted conversations: `packs`, one row per tree (PACKED), and `members` (conv_id, content), which
    names the leaf of every conversation."""

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack: int = PACK):
        """Turns are put in order of turn (nulls first), then role and text; rows that repeat are turns of their own.
        Null roles and texts are empty, and rows without an id are one conversation. Other columns are not read. An
        empty table gives no packs and no members."""
        self.id_col = id_col
        whole = rows.groupBy(F.col(id_col).alias("_conv")).agg(_turns(role_col, text_col, [F.col(turn_col).alias("turn")]).alias("turns"))
        whole = whole.withColumn("content", F.sha2(F.to_json("turns"), 256))
        whole = park(whole, "conversations")
        self.members = whole.select(F.col("_conv").alias(id_col), "content")
        one = whole.groupBy("content").agg(F.first("turns").alias("turns"))
        # Equal initial turns have equal initial hashes, so that the order of these sequences is that of a tree.
        keys = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"]))
        size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]) + F.length(x["role"]) + 30)
        one = park(one.select("content", "turns", F.xxhash64(F.get(F.col("turns"), 0)["role"], F.get(F.col("turns"), 0)["text"]).alias("root"), keys.alias("keys"), size.alias("size")), "distinct")
        large = park(one.groupBy("root").agg(F.sum("size").alias("all")).filter(F.col("all") > pack).select("root"), "large")
        order = one.join(large, "root", "left_semi").select("root", "keys", "content", "size").repartitionByRange("root", "keys", "content")
        order = park(order.withColumn("range", F.spark_partition_id()), "ranges")
        # Places in the order are summed within ranges first and then over the ranges, of which a root has few.
        sums = order.groupBy("root", "range").agg(F.sum("size").alias("n"))
        earlier = W.partitionBy("root").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(F.col("root").alias("_root"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        inside = W.partitionBy("root", "range").orderBy("keys", "content").rowsBetween(W.unboundedPreceding, -1)
        order = order.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        order = order.join(sums, (F.col("root") == F.col("_root")) & (F.col("range") == F.col("_range")))
        cuts = park(order.select(F.col("content").alias("_content"), F.floor((F.col("offset") + F.col("inside")) / F.lit(pack)).alias("cut")), "cuts")
        one = one.join(cuts, F.col("content") == F.col("_content"), "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
        # The pack's name is the only key, and a pack is bounded by construction.
        name = F.concat_ws(":", F.hex("root"), F.col("cut").cast("string"))
        one = one.select(name.alias("pack"), "content", "turns")

        def packed(group: pa.Table) -> pa.Table:
            turns = [[(t["role"], t["text"]) for t in x] for x in group.column("turns").to_pylist()]
            made = build(list(zip(group.column("content").to_pylist(), turns)))
            interval = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(interval))])
            kinds = {"pack": pa.string(), "stream": pa.string(), "nodes": pa.list_(node), "loss": pa.list_(interval), "leaves": pa.list_(pa.struct([("content", pa.string()), ("node", pa.int32())]))}
            made["pack"] = group.column("pack")[0].as_py()
            return pa.table({k: pa.array([made[k]], t) for k, t in kinds.items()})

        self.packs = one.groupBy("pack").applyInArrow(packed, PACKED)

    def tokens(self, path: str) -> DataFrame:
        """The packs as token ids (TOKENS) of the vocabulary at path: every node is encoded by itself, so that a
        conversation's tokens are those of its turns one after the other wherever its tree branches. positions has
        each token's place in its conversations; intervals, as in `packs`, count tokens."""

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(path)
            interval = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("attends", pa.list_(interval))])
            kinds = {"pack": pa.string(), "ids": pa.list_(pa.int32()), "positions": pa.list_(pa.int32()), "nodes": pa.list_(node), "loss": pa.list_(interval), "leaves": pa.list_(pa.struct([("content", pa.string()), ("node", pa.int32())]))}
            for batch in batches:
                for row in batch.to_pylist():
                    made = {"pack": row["pack"], "leaves": row["leaves"], **tokenised(row, own.encode)}
                    yield pa.RecordBatch.from_arrays([pa.array([made[k]], t) for k, t in kinds.items()], names=list(kinds))

        return self.packs.mapInArrow(encode, TOKENS)

    def read(self) -> DataFrame:
        """One row per conversation, read back from the packs: id, n_turns, turns_sha256 (role, line feed, text,
        line feed for each turn), loss_chars and loss_sha256 (texts under the loss mask), formatted_chars, and of the
        tree that it stands in tree_nodes and tree_chars, where shared turns count once."""

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [x.split(" ")[0] for x in READ.split(", ")]
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    for content, turns, under, size in read_back(row):
                        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                        out.append((content, len(turns), hashlib.sha256(whole.encode()).hexdigest(), sum(map(len, under)), hashlib.sha256("".join(under).encode()).hexdigest(), size, len(row["nodes"]), len(row["stream"])))
                columns = list(zip(*out)) or [[] for _ in names]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        # Written first, so that the exchange below a common conversation can be split.
        read = park(self.packs.mapInArrow(digest, READ), "read")
        return self.members.join(read, "content").drop("content")


def format_chats(rows: DataFrame, **options) -> Chats:
    return Chats(rows, **options)
