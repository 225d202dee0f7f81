"""Language ID by language-bitmask n-gram filters (operator 6).

All languages share one bit-sliced Bloom filter: row i holds, as bits, the languages whose filter has bit i set, so
the AND of an n-gram's rows is the set of languages that contain it. A text's n-grams give one count (popcount) for
each language; each is corrected for that filter's false positives, and the greatest share decides.

A language's filter has the n-grams that its sample uses at least ``LEAST`` times and at least ``SHARE`` times as
often, relative to the sample's size, as the language that uses them most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts
from .sample import fold, sampled, within

GRAMS = (2, 3, 4)
#: Rows learned of each language, and characters of the longest: the bounds of the sample.
PER_LANGUAGE, LONGEST = 500, 200_000
LEAST, SHARE = 2, 0.5
UNKNOWN = "und"
#: Characters whose n-grams are hashed at once.
CHUNK = 1 << 17
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes_of(text: str) -> np.ndarray:
    """Lower-case code points with each run of other characters than letters as one space, one at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[c]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, c, 32)[keep]
    return out


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hashes of all n-grams."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = c[: len(c) - n + 1] + np.uint64(n)
    for k in range(1, n):
        h = h * _MUL + c[k : len(c) - n + 1 + k]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


class Filters:
    """The bit-sliced Bloom filter, two probes an n-gram; languages beyond 64 take further words of a row."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        most = max([1, *(len(g) for g in grams)])
        self.rows = 1 << max(10, int(np.ceil(np.log2(5 * most))))
        words = (len(languages) + 63) // 64
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.table = np.zeros((words, self.rows), kind)
        for i, own in enumerate(grams):
            for at in self.probes(own):
                self.table[i // 64, at] |= kind(1 << i % 64)
        fill = [np.count_nonzero(self.table[i // 64] & kind(1 << i % 64)) / self.rows for i in range(len(languages))]
        self.false_positive = np.array(fill) ** 2

    def probes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(self.rows - 1)
        return (h & low).astype(np.intp), ((h >> np.uint64(32)) & low).astype(np.intp)

    def counts(self, codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For n texts, the n-grams in each language's filter and the n-grams; ``of`` is the text of each code.
        N-grams that reach into the next text, or lie between words, don't count."""
        found, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for size in GRAMS:
            if len(codes) < size:
                continue
            h = hashes(codes, size)
            own = of[: len(h)]
            whole = own == of[size - 1 :]
            h, own = h[whole], own[whole]
            total += np.bincount(own, minlength=n)
            a, b = self.probes(h)
            for w, rows in enumerate(self.table):
                mask = rows[a] & rows[b]
                for i in range(w * 64, min(len(self.languages), w * 64 + 64)):
                    bit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                    found[:, i] += np.bincount(own, weights=bit, minlength=n)
        return found, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [codes_of(t or "") for t in texts]
        n = len(texts)
        found, total = np.zeros((n, len(self.languages))), np.zeros(n)
        at = 0
        while at < n:  # short texts go together, long ones in overlapping pieces
            end, held = at, 0
            while end < n and (held == 0 or held + len(codes[end]) <= CHUNK):
                held += len(codes[end])
                end += 1
            if end - at == 1 and held > CHUNK:
                c = codes[at]
                for k in range(0, len(c), CHUNK):
                    for size in GRAMS:  # each n-gram once: pieces overlap by one character less than it has
                        piece = c[k : k + CHUNK + size - 1]
                        f, t = self._one(piece, size)
                        found[at] += f
                        total[at] += t
            else:
                part = codes[at:end]
                f, t = self.counts(np.concatenate(part), np.repeat(np.arange(end - at), [len(c) for c in part]), end - at)
                found[at:end] += f
                total[at:end] += t
            at = end
        right = np.maximum(found - total[:, None] * self.false_positive, 0) / (1 - self.false_positive)
        best = right.argmax(1) if self.languages else np.zeros(n, int)
        whole = right.sum(1)
        score = np.divide(right.max(1, initial=0), whole, out=np.zeros(n), where=whole > 0)
        blank = np.array([len(c) < 3 for c in codes])  # no letter: at most the two spaces
        names = [UNKNOWN if x or not self.languages else self.languages[i] for x, i in zip(blank.tolist(), best.tolist(), strict=True)]
        return names, np.where(blank, 0.0, np.clip(score, 0, 1)).tolist()

    def _one(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
        h = hashes(codes, size)
        a, b = self.probes(h)
        f = np.zeros(len(self.languages))
        for i in range(len(self.languages)):
            mask = self.table[i // 64]
            f[i] = np.count_nonzero((mask[a] & mask[b]) & mask.dtype.type(1 << i % 64))
        return f, len(h)


def learn(rows: pd.DataFrame) -> Filters:
    """Filters from rows (text, label); languages in the order of their rows, which breaks ties."""
    order = rows.groupby("label").size().reset_index(name="n").sort_values(["n", "label"], ascending=[False, True])
    languages = order.label.tolist()
    uses: list[tuple[np.ndarray, np.ndarray]] = []
    for language in languages:
        found: list[list[np.ndarray]] = [[] for _ in GRAMS]
        for text in rows.text[rows.label == language]:
            c = codes_of(text or "")
            for own, n in zip(found, GRAMS, strict=True):
                own.append(hashes(c, n))
        parts = [np.unique(np.concatenate(own), return_counts=True) for own in found]
        # relative uses are by size of n-gram
        uses.append((np.concatenate([p[0] for p in parts]), np.concatenate([np.where(p[1] >= LEAST, p[1] / max(1, p[1].sum()), 0) for p in parts])))
    every = np.unique(np.concatenate([u[0] for u in uses])) if uses else np.zeros(0, np.uint64)
    most = np.zeros(len(every))
    for grams, rate in uses:
        at = np.searchsorted(every, grams)
        most[at] = np.maximum(most[at], rate)
    kept = [grams[(rate > 0) & (rate >= SHARE * most[np.searchsorted(every, grams)])] for grams, rate in uses]
    return Filters(languages, kept)


def train(documents: DataFrame, folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE, longest: int = LONGEST, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters learned from a bounded sample of the rows outside the held-out fold: about ``per_language`` rows of
    each language, of at most ``longest`` characters, and of about ``sample.CHARS`` in all. Rows with a null text, id or language teach nothing."""
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    rows = rows.where((fold("id", folds) != held) & (F.length("text") <= longest))
    chosen = within(sampled(rows, "id", "label", per_language)).toPandas()
    return learn(chosen.sort_values(["id", "label", "text"], kind="stable"))


def identify(df: DataFrame, filters: Filters, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the language of each whole text and its share of the corrected counts (0 to 1).

    ``und`` and 0 for null texts and texts without a letter, or if no language was learned. Equal counts go to the
    language of more learned rows. Repeated rows are judged each; columns named like an output are replaced. The
    filters, whose size follows the bounded sample, are broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(filters)

    def start():
        return sent.value.predict

    return map_texts(df, text, {lang: T.StringType(), score: T.DoubleType()}, start, keep)
