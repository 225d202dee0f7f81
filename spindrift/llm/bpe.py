"""Byte-level BPE encoding and decoding (operator 1).

Two tiers: a minimal perfect hash resolves pre-tokens that are whole vocabulary entries; every other pre-token is
merged by a heap over a linked list of its bytes. A bounded memo in each worker keeps the results of short
pre-tokens. Texts are processed whole, in slices of rows, without a shuffle; nothing but the vocabulary (a file of
fixed size) is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts

#: Pre-tokens of each of the memo's two generations, and the length in characters from which a pre-token isn't kept there.
MEMO, MEMO_LENGTH = 120_000, 48
#: Bytes from which a pre-token is merged in arrays of machine integers, a quarter of the lists' memory.
LONG = 4096
NONE = -1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, space, rank a line), by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be dense")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash from byte strings to their index: as many slots as keys, one probe, one comparison.

    Keys fall into buckets; a bucket's displacement d, found largest bucket first, sends its keys to the free
    slots (a + d * b) mod n. A bucket of one key stores its slot directly, as -1 - slot.
    """

    def __init__(self, keys: list[bytes], seed: int = 0):
        self.keys, self.n = keys, max(1, len(keys))
        self.buckets = max(1, len(keys) // 4)
        while not self._place(seed):
            seed += 1

    def _place(self, seed: int) -> bool:
        self.seed, n = seed, self.n
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(self.keys):
            h = xxhash.xxh64_intdigest(key, seed)
            buckets[h % self.buckets].append((h >> 40, (h >> 16 & 0xFFFFFF) | 1, i))
        shift, slots = [0] * self.buckets, [NONE] * n
        free = iter(range(n))
        for at in sorted(range(self.buckets), key=lambda b: -len(buckets[b])):
            own = buckets[at]
            if len(own) > 1:
                for d in range(1 << 16):
                    to = {(a + d * b) % n for a, b, _ in own}
                    if len(to) == len(own) and all(slots[s] == NONE for s in to):
                        break
                else:
                    return False
                shift[at] = d
                for a, b, i in own:
                    slots[(a + d * b) % n] = i
            elif own:
                s = next(x for x in free if slots[x] == NONE)
                shift[at], slots[s] = -1 - s, own[0][2]
        self.shift, self.slots = shift, slots
        return True

    def get(self, key: bytes) -> int:
        """The index of ``key``, or NONE."""
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        i = self.slots[-1 - d if d < 0 else ((h >> 40) + d * ((h >> 16 & 0xFFFFFF) | 1)) % self.n]
        return i if i != NONE and self.keys[i] == key else NONE


class Codec:
    """Encodes text to token ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.whole = PerfectHash(tokens)
        ids = {t: i for i, t in enumerate(tokens)}
        self.of_byte = [ids.get(bytes([b]), NONE) for b in range(256)]
        if NONE in self.of_byte:
            raise ValueError("every byte must be a token")
        #: (left id << 20 | right id) -> the id, and so the rank, of the two joined.
        self.pairs = {ids[t[:k]] << 20 | ids[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.memo = _Memo(self)

    def __reduce__(self):
        return _same, (self.tokens, self.find.__self__.pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank joins first, the leftmost of equals."""
        n, join = len(piece), self.pairs.get
        held = list if n < LONG else lambda x: array("q", x)
        ids = held(self.of_byte[b] for b in piece)
        following, before = held(range(1, n + 1)), held(range(-1, n - 1))
        rank = held(join(ids[i] << 20 | ids[i + 1], NONE) for i in range(n - 1))
        rank.append(NONE)
        heap = [r << 40 | i for i, r in enumerate(rank) if r != NONE]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFFFF, x >> 40
            if rank[i] != r:
                continue  # the pair has changed since
            j = following[i]
            k = following[j]
            ids[i], following[i], rank[j], rank[i] = r, k, NONE, NONE
            if k < n:
                before[k] = i
                if (c := join(r << 20 | ids[k], NONE)) != NONE:
                    rank[i] = c
                    heappush(heap, c << 40 | i)
            p = before[i]
            if p >= 0:
                rank[p] = c = join(ids[p] << 20 | r, NONE)
                if c != NONE:
                    heappush(heap, c << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out

    def piece(self, word: str) -> bytes:
        raw = word.encode()
        i = self.whole.get(raw)
        return pack("<I", i) if i != NONE else np.array(self.merged(raw), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text))) if text else b""

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""


class _Memo(dict):
    """Results by pre-token, in two generations: when the young one is full it becomes the old one, and what is met
    again moves up, so frequent pre-tokens stay."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.codec.piece(word)
        if len(word) < MEMO_LENGTH:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


_codecs: dict[tuple, Codec] = {}


def _same(tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each vocabulary and pattern in a process, so that reused workers build it once."""
    key = (pattern, len(tokens), hash(tuple(tokens)))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The broadcast vocabulary; its size is that of the rank file, whatever the corpus."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encode(df: DataFrame, vocab: Broadcast, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the token ids of every whole text.

    ``ids`` is binary, little-endian unsigned 32-bit integers (``unpacked`` gives an array); ``n_tokens`` is long.
    Null and empty texts have no ids. Repeated rows are encoded each; columns named like an output are replaced; a
    table without rows gives none.
    """

    def start():
        codec = _same(*vocab.value)

        def run(texts):
            packed = [codec.encode(t) for t in texts]
            return packed, [len(p) // 4 for p in packed]

        return run

    return map_texts(df, text, {ids: T.BinaryType(), n_tokens: T.LongType()}, start, keep)


def round_trip(df: DataFrame, vocab: Broadcast, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode``, and the bytes that the ids decode to, in one worker: with one vocabulary there, not two."""

    def start():
        codec = _same(*vocab.value)

        def run(texts):
            packed = [codec.encode(t) for t in texts]
            return packed, [len(p) // 4 for p in packed], list(map(codec.decode, packed))

        return run

    return map_texts(df, text, {ids: T.BinaryType(), n_tokens: T.LongType(), decoded: T.BinaryType()}, start, keep)


def decode(df: DataFrame, vocab: Broadcast, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes that packed ids stand for (null ids: no bytes)."""

    def start():
        codec = _same(*vocab.value)
        return lambda packed: (list(map(codec.decode, packed)),)

    return map_texts(df, ids, {decoded: T.BinaryType()}, start, keep)


def unpacked(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with the packed column as array<int>."""

    def start():
        return lambda packed: ([np.frombuffer(p or b"", "<u4").astype("i4") for p in packed],)

    return map_texts(df, ids, {ids: T.ArrayType(T.IntegerType())}, start)


