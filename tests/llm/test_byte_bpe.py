import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicebox.llm.byte_bpe import Codec, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WHOLE = Codec(PATH)
LEAVES = [Codec(PATH, leaf=n) for n in (1, 3, 7, 40)]
PIECES = st.sampled_from(["the", " ", "  ", "\n", "\t", "'", "'re", "'s", "9", "12", "é", "ß", "\x1c", "\x85", " ", "漢字", "😀", "!!", "a", "A b", "<|endoftext|>", "​", "\r\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join) | st.text(max_size=80))
def test_tree_equals_whole(text):
    plain = WHOLE.encoding.encode_ordinary(text)
    for codec in LEAVES:
        ids = codec.encode(text)
        assert ids.tolist() == plain
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 5_000 + "x", "ab " * 30_000, "漢" * 40_000, "word\n" * 20_000 + "'re"])
def test_long_texts(text):
    assert WHOLE.encode(text).tolist() == WHOLE.encoding.encode_ordinary(text)


def test_operator(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (None, "null id", "z"), (1, "Hello world", "x"), (2**60 + 1, "été " * 9000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded).decode()) for r in encode_decode(docs, PATH).collect())
    want = sorted((i or 0, len(ids := WHOLE.encoding.encode_ordinary(t or "")), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), t or "") for i, t, _ in rows)
    assert got == want
    assert encode_decode(docs.limit(0), PATH).collect() == []
