import base64
import struct

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(5000))
    assert [table.get(k) for k in keys] == list(range(5000))
    assert table.get(b"none") == bpe.NONE


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encodes_like_the_library_and_back(codec, reference, text):
    packed = codec.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(text)
    assert codec.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "aé😀" * 4000, " " * 3000 + "x", "<|endoftext|> it's 12\r\n\t"])
def test_long_and_odd_texts(codec, reference, text):
    packed = codec.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(text)


def test_memo_generations_stay_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    codec.memo.clear()
    for i in range(100):
        codec.encode(f"word{i} word{i % 3}")
    assert len(codec.memo) <= 11 and len(codec.memo.old) <= 11


def test_frames(spark):
    vocab = bpe.vocabulary(spark, PATH, public.PATTERN)
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hello world", "k"), (3, "Hello world", "k")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, vocab), vocab).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 0, 2, 2]
    assert [bytes(r.decoded) for r in rows] == [b"", b"", b"Hello world", b"Hello world"]
    assert [r.ids for r in bpe.unpacked(bpe.encode(df.where("doc_id = 3"), vocab)).collect()] == [[15496, 995]] * 2
    assert bpe.encode(df.limit(0), vocab).count() == 0
