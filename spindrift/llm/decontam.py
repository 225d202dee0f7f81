"""Benchmark decontamination by a prefix-filtered set join (operator 5).

Every item gives windows of consecutive words, and a window its shingles of WIDTH words. Shingles are ordered by how
many times the whole corpus uses them; a match of ``share`` of a window's n words has m = n - ceil(share * n) words out
of place, which take m * WIDTH shingles at most, so one of the m * WIDTH + 1 rarest, the prefix, is whole in it (short
windows, of which nothing might be whole, have shorter shingles). Only document positions of prefix shingles are joined. The positional bound puts the window at
one place for each joined position, the length bound drops places that leave the document, and each place left is
verified word by word over the window. Prefix shingles are looked up in a table of one block of windows, at most
``BLOCK`` of them, cut from all windows in their order; further blocks are further passes, so what is broadcast has a
fixed bound, also if many items share a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordinals import ordinal
from .common import checkpointed, map_texts, slices
from .words import split_words

#: Windows in one broadcast block, about 40 bytes each besides their words.
BLOCK = 200_000
#: Words of a shingle, at most.
WIDTH = 3
SPANS = T.ArrayType(T.LongType())
NAMES = T.ArrayType(T.StringType())
OUTPUTS = {"n_hit": T.LongType(), "hit_spans": SPANS, "items": NAMES, "contaminated": T.BooleanType()}


def item_windows(benchmark: DataFrame, size: int, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words): the distinct windows of each item; an item of fewer words, but not none, is one window.

    Null texts have no words. Equal windows stay one for each item. Null ids are items of the name ''.
    """
    schema = "item string, words array<binary>"

    def run(batches):
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = split_words(t)
                found = list({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}) if w else []
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_pydict({"item": [i or ""] * len(part), "words": list(map(list, part))}, schema=pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary()))]))

    return benchmark.select(F.col(id).cast("string"), F.col(text)).mapInArrow(run, schema)


def window_blocks(windows: DataFrame, block: int) -> DataFrame:
    """(item, words, block): the windows, written out, in numbered blocks of ``block`` of them at most."""
    return checkpointed(ordinal(windows, ["item", "words"], "nth", 0).select("item", "words", F.floor(F.col("nth") / block).cast("int").alias("block")))


def width_of(n: int, need: int) -> int:
    """Words of the shingles of a window of n words: the most, up to WIDTH, at which one shingle is whole in every
    match of ``need`` words, as each word out of place takes ``width`` shingles at most."""
    return max(w for w in range(1, WIDTH + 1) if w == 1 or n - w + 1 > (n - need) * w)


class Shingles:
    """The word codes of one block of windows, and its distinct shingles by width, as sorted numbers."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], share: float):
        self.code = {w: i for i, w in enumerate(sorted({w for _, words in rows for w in words}))}
        self.base = len(self.code) + 1
        if self.base**WIDTH >= 1 << 63:
            raise ValueError("a block has too many words: take a smaller one")
        self.length = np.array([len(words) for _, words in rows], np.int64)
        self.need = np.array([math.ceil(share * n) for n in self.length.tolist()], np.int64)
        self.words = np.full((len(rows), int(self.length.max(initial=1))), -2, np.int64)
        for i, (_, words) in enumerate(rows):
            self.words[i, : len(words)] = [self.code[w] for w in words]
        #: Windows by their shingles' width, and the numbers of all shingles of each width.
        self.width = np.array([width_of(n, need) for n, need in zip(self.length.tolist(), self.need.tolist(), strict=True)], np.int64)
        self.keys = {w: np.unique(np.concatenate([self.numbers(self.words[i, : self.length[i]], w) for i in np.flatnonzero(self.width == w)])) for w in set(self.width.tolist())}

    def numbers(self, codes: np.ndarray, width: int) -> np.ndarray:
        """The number of the shingle at each place; negative if it has an unknown word."""
        n = max(0, len(codes) - width + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            own = codes[i : i + n]
            out, known = out * self.base + own, known & (own >= 0)
        return np.where(known, out, -1)

    def found(self, codes: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in ``keys``) of the block's shingles of a width; ``end`` bounds each position's document."""
        numbers, keys = self.numbers(codes, width), self.keys[width]
        at = np.flatnonzero(numbers >= 0)
        at = at[at + width <= end[at]]
        i = np.searchsorted(keys, numbers[at])
        same = keys[np.minimum(i, len(keys) - 1)] == numbers[at]
        return at[same], i[same]


def _coded(texts: list, code: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, ends, codes) of the words of all texts, one after the other; unknown words are -1."""
    words, get = [split_words(t) for t in texts], code.get
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return sizes, ends, np.fromiter((get(w, -1) for own in words for w in own), np.int64, int(ends[-1]) if len(ends) else 0)


def corpus_counts(documents: DataFrame, block, text: str = "text") -> DataFrame:
    """(width, i, n): the uses, in all documents, of each shingle (by its index) of a broadcast block of windows."""

    def run(batches):
        shingles = _cached(Shingles, block)
        sums = {w: np.zeros(len(k), np.int64) for w, k in shingles.keys.items()}
        for batch in batches:
            for at, size in slices(batch.column(0)):
                sizes, ends, codes = _coded(batch.column(0).slice(at, size).to_pylist(), shingles.code)
                for w, own in sums.items():
                    own += np.bincount(shingles.found(codes, np.repeat(ends, sizes), w)[1], minlength=len(own))
        for w, own in sums.items():
            i = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), w, np.int32)), pa.array(i.astype(np.int64)), pa.array(own[i])], names=["width", "i", "n"])

    return documents.select(F.col(text)).mapInArrow(run, "width int, i long, n long").groupBy("width", "i").agg(F.sum("n").alias("n"))


class Windows(Shingles):
    """One block of windows, ready to be found in documents: the prefix of each, its rarest shingles."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], share: float, counts: list[tuple[int, int, int]] = ()):
        super().__init__(rows, share)
        self.item = [item for item, _ in rows]
        uses = {w: np.zeros(len(k), np.int64) for w, k in self.keys.items()}
        for w, i, n in counts:
            uses[w][i] = n
        self.joined: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w, keys in self.keys.items():
            prefix: list[tuple[int, int, int]] = []
            for i in np.flatnonzero(self.width == w).tolist():
                n = int(self.length[i])
                own = np.searchsorted(keys, self.numbers(self.words[i, :n], w))
                rarest = np.lexsort((np.arange(len(own)), own, uses[w][own]))[: (n - int(self.need[i])) * w + 1]
                prefix += [(int(own[p]), i, p) for p in rarest.tolist()]
            found = np.array(sorted(prefix), np.int64).reshape(-1, 3)
            # the joined rows of a shingle are one slice
            self.joined[w] = found[:, 1], found[:, 2], np.searchsorted(found[:, 0], np.arange(len(keys) + 1))

    def find(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of all occurrences; ``begin`` and ``end`` bound the document of each position."""
        windows, starts = [], []
        for width, (window, place, low) in self.joined.items():
            at, key = self.found(codes, end, width)
            n = low[key + 1] - low[key]
            at, key, n = at[n > 0], key[n > 0], n[n > 0]
            for k in range(0, len(at), 1 << 16):  # bounds the joined rows held at once
                a, b, m = at[k : k + (1 << 16)], key[k : k + (1 << 16)], n[k : k + (1 << 16)]
                for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(m) // (1 << 20))) + 1):
                    row = np.repeat(low[b[part]], m[part]) + np.arange(m[part].sum()) - np.repeat(np.cumsum(m[part]) - m[part], m[part])
                    position = np.repeat(a[part], m[part])
                    w, start = window[row], position - place[row]
                    inside = (start >= begin[position]) & (start + self.length[w] <= end[position])
                    w, start = w[inside], start[inside]
                    same = np.zeros(len(w), np.int64)
                    for p in range(self.words.shape[1]):
                        there = p < self.length[w]
                        same += there & (codes[np.minimum(start + p, len(codes) - 1)] == self.words[w, p])
                    good = same >= self.need[w]
                    windows.append(w[good])
                    starts.append(start[good])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(windows), np.concatenate(starts)]), axis=1)
        return both[0], both[1]


_built: dict[tuple, Shingles] = {}


def _cached(kind: type, block):
    """One index for each block in a process, so that reused workers build it once."""
    name, *made = block.value
    if (name, kind) not in _built:
        _built.clear()
        _built[name, kind] = kind(*made)
    return _built[name, kind]


def _judged(spans: list[list[int]], items: list) -> tuple[list, list, list, list]:
    """n_hit, the merged spans, the items, and whether there is a hit, of each document."""
    n_hit, merged = [], []
    for own in spans:
        flat: list[int] = []
        for a, b in sorted(zip(own[::2], own[1::2], strict=True)):
            if flat and a <= flat[-1]:
                flat[-1] = max(flat[-1], b)
            else:
                flat += [a, b]
        n_hit.append(sum(flat[1::2]) - sum(flat[::2]))
        merged.append(flat)
    return n_hit, merged, [sorted(set(x)) for x in items], [n > 0 for n in n_hit]


def _occurrences(documents: DataFrame, block, text: str, keep: list[str], names: dict, made: Callable = lambda spans, items: (spans, [sorted(x) for x in items])) -> DataFrame:
    """``documents`` with n_words, and what ``made`` gives for the hit word ranges and items of one block."""

    def start():
        windows = _cached(Windows, block)

        def run(texts):
            sizes, ends, codes = _coded(texts, windows.code)
            begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
            w, at = windows.find(codes, begin, end)
            doc = np.searchsorted(ends, at, "right")
            spans: list[list[int]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            for k, d, a in zip(w.tolist(), doc.tolist(), at.tolist(), strict=True):
                a -= int(ends[d] - sizes[d])
                spans[d] += [a, a + int(windows.length[k])]
                items[d].add(windows.item[k])
            return sizes.tolist(), *made(spans, items)

        return run

    return map_texts(documents, text, names, start, keep)


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, share: float = 1.0, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``documents`` with n_words, n_hit, hit_spans (word ranges [start, end) of hits, merged, flat), items (sorted
    distinct item ids, as strings) and contaminated (n_hit > 0).

    A document word is hit if it lies inside an occurrence of a window: ``size`` consecutive words of an item (all
    of a shorter item), of which at least ``share`` stand at their places in the document. Null texts have no words;
    repeated rows are judged each; an empty benchmark hits nothing; columns named like an output are replaced.
    Passes over the documents for each ``block`` windows: one for the counts, and one for the join. What comes to the
    driver and is broadcast has the size of a block.
    """
    spark = documents.sparkSession
    names = {"n_words": T.LongType(), "_spans": SPANS, "_items": NAMES}
    stay = [c for c in (documents.columns if keep is None else keep) if c not in names and c not in OUTPUTS]
    parts = window_blocks(item_windows(benchmark, size, item_id, item_text), block)
    blocks = 1 + (parts.agg(F.max("block")).first()[0] or 0)
    now, held = documents, None
    for b in range(blocks):
        own = parts.where(F.col("block") == b)
        rows = [(r.item, [bytes(w) for w in r.words]) for r in own.select("item", "words").collect()]
        counted = corpus_counts(documents, spark.sparkContext.broadcast((uuid4().hex, rows, share)), text) if rows else None
        uses = [tuple(r) for r in counted.collect()] if rows else []
        sent = spark.sparkContext.broadcast((uuid4().hex, rows, share, uses))
        last = b == blocks - 1
        if last and not held:  # one block, as a rule: all in one pass
            return _occurrences(now, sent, text, stay, {"n_words": T.LongType()} | OUTPUTS, _judged)
        found = _occurrences(now, sent, text, [*stay, *([text] if not last and text not in stay else []), *(["_held_spans", "_held_items"] if held else [])], names)
        if held:
            found = found.withColumns({"_spans": F.concat("_held_spans", "_spans"), "_items": F.concat("_held_items", "_items")}).drop("_held_spans", "_held_items")
        if not last:
            now, held = checkpointed(found).withColumnsRenamed({"_spans": "_held_spans", "_items": "_held_items"}).drop("n_words"), True

    both = found.select(*[F.col(f"`{c}`") for c in stay], "n_words", F.struct(F.col("_spans").alias("spans"), F.col("_items").alias("items")).alias("_found"))

    def merge():
        return lambda rows: _judged([r["spans"] for r in rows], [r["items"] for r in rows])

    return map_texts(both, "_found", OUTPUTS, merge, [*stay, "n_words"])
