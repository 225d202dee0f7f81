"""Periodic run detection (operator 11), by the method of Kolpakov and Kucherov.

A run is a stretch of words whose smallest period fits in it at least twice and that no neighbouring word extends. A
suffix automaton gives the Lempel-Ziv factors of the words, each with its first earlier occurrence. Main's algorithm,
on longest common extensions around each border of two factors, finds the runs that touch a border; every other run
lies inside a factor, and is copied from the factor's earlier occurrence.

Long runs are rare in prose, so most words never reach the automaton: in a run of ``least`` words or more, every word
lies in a stretch of ``least / 2`` words that occurs twice in the run. Words outside such stretches cut a text into
pieces, and a run lies in one piece whole. Hashes of stretches are compared there, so a collision can only keep
words that could have been cut.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Times that pieces are cut anew, each on the repeats within the pieces before; any number gives the same runs.
CUTS = 8

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence, with the first position at which the strings of each state end."""

    def __init__(self, s: list[int]):
        step: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(s):
            new = len(step)
            step.append({})
            length.append(i + 1)
            first.append(i)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
            last = new
        self.step, self.first = step, first


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors: each the longest string that occurs earlier, overlaps
    allowed, or a new element (earlier start -1)."""
    automaton = Automaton(s)
    step, first = automaton.step, automaton.first
    found, i, n = [], 0, len(s)
    while i < n:
        state, end = 0, i
        while end < n:
            to = step[state].get(s[end])
            if to is None or first[to] >= end:
                break
            state, end = to, end + 1
        if end == i:
            found.append((i, 1, -1))
            i += 1
        else:
            found.append((i, end - i, first[state] - (end - i) + 1))
            i = end
    return found


def extensions(s: list[int]) -> list[int]:
    """The length of the longest common prefix of the sequence and each of its suffixes."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _touching(s: list[int], border: int, before: int, after: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs that touch the border of factors of ``before`` and ``after`` elements and end within the second;
    (start, end) to the smallest period. Longer ones touch the next border, too."""
    n = len(s)
    low, high = max(0, border - 2 * before - after), min(n, border + after)
    x, y = s[low:border], s[border:high]
    back = x[::-1]
    ahead = extensions([*y, -1, *x, *y])
    behind = extensions([*back, -1, *y[::-1], *back])
    a, b = len(x), len(y)
    for q in range(1, min(before + after, a + b + 1)):
        spans = []
        if q <= b:  # a period right of the border
            spans.append((border - (behind[a + 1 + b - q]), border + q + (ahead[q] if q < b else 0)))
        if q <= a:  # a period left of it
            spans.append((border - q - (behind[q] if q < a else 0), border + ahead[b + 1 + a - q]))
        for start, end in spans:
            if end - start < 2 * q or end - start < least or found.get((start, end), q + 1) <= q:
                continue
            if (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q]):
                found[start, end] = q


def runs(s: list[int], least: int = 2) -> list[Run]:
    """(start, length, period) of all runs of ``least`` elements or more, by start, then period. Elements are not
    negative."""
    parts = factors(s)
    found: dict[tuple[int, int], int] = {}
    short = (least + 1) // 2  # a run's length less its period is at least this, and less than the two factors' lengths
    for (_, before, _), (border, after, _) in zip(parts, [*parts[1:], (len(s), 0, -1)], strict=False):
        if before + after > short:
            _touching(s, border, before, after, least, found)
    at: dict[int, dict[int, int]] = defaultdict(dict)
    for (start, end), q in found.items():
        at[start][end] = q
    for border, size, earlier in parts:
        if size > least:
            for i in range(1, size - least):
                for end, q in list(at.get(earlier + i, {}).items()):
                    if end < earlier + size:
                        at[border + i].setdefault(end + border - earlier, q)
    return sorted(((start, end - start, q) for start, own in at.items() for end, q in own.items()), key=lambda r: (r[0], r[2]))


def pieces(words: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of many texts' words (numbered; ``text`` has the text of each word) that may hold
    runs: each word in a stretch of ``least / 2`` words that occurs again in its piece."""
    size = (least + 1) // 2
    n = len(words) - size + 1
    if n < 1:
        return []
    h = np.zeros(n, np.uint64)
    for j in range(size):
        x = words[j : j + n].astype(np.uint64) + np.uint64(1)
        h = (h ^ (x * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    piece = text[at].astype(np.uint64)
    for _ in range(CUTS):
        key = h[at] ^ (piece * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order] = np.r_[same, False] | np.r_[False, same] if len(at) else False
        if again.all():
            break
        at = at[again]
        piece = np.cumsum(np.r_[False, (np.diff(at) > size) | (text[at[1:]] != text[at[:-1]])] if len(at) else []).astype(np.uint64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, (np.diff(at) > size) | (text[at[1:]] != text[at[:-1]])])
    ends = at[np.r_[cut[1:] - 1, len(at) - 1]] + size
    return [(a, b) for a, b in zip(at[cut].tolist(), ends.tolist(), strict=True) if b - a >= least]


def _found(texts: list[str | None], least: int) -> tuple[list[list[Run]], list[str], list[int]]:
    split = [(t or "").encode().split() for t in texts]  # bytes: ASCII white space only
    sizes = np.array([len(w) for w in split], np.int64)
    ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(split)), sizes)
    begins = np.cumsum(sizes) - sizes
    own: list[list[Run]] = [[] for _ in split]
    for start, end in pieces(words, text, least):
        i = int(text[start])
        shift = start - int(begins[i])
        own[i] += [(s + shift, length, q) for s, length, q in runs(words[start:end].tolist(), least)]
    kept = []
    for w, found in zip(split, own, strict=True):
        if found:
            drop = np.zeros(len(w) + 1, np.int64)
            for s, length, q in found:
                drop[s + q] += 1
                drop[s + length] -= 1
            w = list(itertools.compress(w, (np.cumsum(drop[:-1]) == 0).tolist()))
        kept.append(b" ".join(w).decode())
    return own, kept, sizes.tolist()


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """``df`` with, for each whole text, ``runs`` (all runs of ``least`` words or more, with start, length and period in
    words, by start, then period), ``collapsed`` (the text without the words of a run that follow its first period,
    words joined by one space) and ``n_words``.

    Words are what ASCII white space separates. Null and empty texts have no words, no runs and an empty collapsed
    text. A text is one value, and its automaton lies in the memory of one task. Other columns of these names are
    replaced; repeated rows stay; no rows give no rows. No shuffle.
    """
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])

    def start():
        def f(texts):
            own, kept, sizes = _found(texts, least)
            return [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in own], kept, sizes

        return f

    return map_texts(df, text, {"runs": T.ArrayType(run), "collapsed": T.StringType(), "n_words": T.LongType()}, start, keep)
