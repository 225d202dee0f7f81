"""Quality scores by Bradley-Terry pairwise ranking (operator 8).

A document's strength is a weighted sum of features of its whole text. The weights are learned from preference
pairs, a good document over a bad one, by the logistic loss on the difference of their features; the decision is a
quantile of the sample's scores. Scores in the executors are one pass over the texts without a shuffle.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Rows learned of each label, and characters of the longest: the bounds of the sample.
PER_LABEL, LONGEST = 2500, 100_000
PAIRS, ROUNDS, RIDGE = 40_000, 30, 1e-3
#: The score at the chosen quantile: rows at or above it are accepted.
CUT = 0.3

_KINDS = np.zeros((256, 7), np.float64)
for _i, _set in enumerate((b"|", b"!", b"#$%&*+<=>@\\^_`{}~[]/", b".,;:?'\"()-", b"0123456789", bytes(range(65, 91)), b"\n")):
    _KINDS[list(_set), _i] = 1
NAMES = ("bar", "bang", "symbol", "stop", "digit", "capital", "line", "log_words", "word_length", "short_words", "distinct", "adjacent", "top_lines", "symbol_any", "capital_much", "repeats", "fragments")


def features(text: str | None) -> list[float]:
    """Features of one whole text (null: of an empty one)."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n).tolist()
    distinct = len(set(words)) / m
    adjacent = sum(map(eq, words, words[1:])) / m
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # the more words, the fewer of them are new; the power levels that out
    typical = min(1.0, 1.6 * m**-0.12)
    lines_again = 1 - len(set(lines)) / max(1, len(lines))
    return [
        *shares, float(np.log1p(len(words))), sizes.sum() / m, np.count_nonzero(sizes <= 3) / m, distinct, adjacent, lines_again,
        float(np.sqrt(shares[0] + shares[1] + shares[2])), float(shares[5] > 0.15), max(0.0, typical - distinct), np.count_nonzero(sizes <= 1) / m,
    ]


class Ranker:
    """score = sigmoid(slope * (strength - cut) + logit(CUT)), where strength is the weighted sum of features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float = 0.0, slope: float = 1.0):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    @property
    def learned(self) -> bool:
        return bool(self.weights.any())

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.learned:
            return [CUT] * len(texts)
        x = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
        z = self.slope * (self.strengths(x) - self.cut) + np.log(CUT / (1 - CUT))
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def fit(rows: pd.DataFrame, seed: int = 8) -> Ranker:
    """A ranker from rows (text, label); label 1 is preferred to 0.

    Newton steps on the ridge-penalised logistic loss of PAIRS random pairs. The cut is the quantile of the
    sample's strengths that divides the labels best (the mean of the shares of each label on its side). Without rows of
    both labels there is nothing to prefer, and every text has the score CUT itself: none is rejected.
    """
    x, y = np.array([features(t) for t in rows.text]).reshape(-1, len(NAMES)), rows.label.to_numpy()
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    out = Ranker(mean, scale, np.zeros(len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return out
    rng = np.random.default_rng(seed)
    unit = np.clip((x - mean) / scale, -6, 6)
    pairs = unit[rng.choice(good, PAIRS)] - unit[rng.choice(bad, PAIRS)]
    w = out.weights
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(pairs @ w, -30, 30)))  # that the preferred one wins
        step = np.linalg.solve((pairs.T * (p * (1 - p))) @ pairs / PAIRS + RIDGE * np.eye(len(w)), pairs.T @ (1 - p) / PAIRS - RIDGE * w)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    out.weights = w
    s = out.strengths(x)
    cuts = np.quantile(s, np.linspace(0.01, 0.99, 197))
    balance = [((s[good] >= c).mean() + (s[bad] < c).mean()) / 2 for c in cuts]
    best = np.flatnonzero(np.array(balance) >= max(balance) - 1e-9)
    out.cut = float(cuts[best[len(best) // 2]])
    return out


def score(df: DataFrame, ranker: Ranker, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the quality of each whole text, 0 to 1; from CUT on it is accepted.

    Null and empty texts have the score of an empty text's features; repeated rows are scored each; a column named
    like the output is replaced. The ranker, of fixed size, is broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(ranker)

    def start():
        return lambda texts: (sent.value.scores(texts),)

    return map_texts(df, text, {out: T.DoubleType()}, start, keep)
