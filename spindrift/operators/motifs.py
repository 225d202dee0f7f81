"""Discovery of motifs by expectation-maximisation: the sequences stay in the executors, and each task sends one matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized
from .mapping import codes

#: Counts of a letter that each place has before any sequence is seen.
PRIOR = 0.1
#: Models that the first round tries.
MODELS = 512
#: Windows times models that are weighed at once.
CELLS = 1 << 18


@dataclass(frozen=True)
class Motif:
    """Letter shares of each place (width, 4), the share of sequences with a site, and the objective of each round."""

    matrix: np.ndarray
    share: float
    history: tuple[float, ...]

    @property
    def consensus(self) -> str:
        return "".join("ACGT"[i] for i in self.matrix.argmax(1))

    @property
    def information(self) -> float:
        """Bits over equal letters."""
        return float((2 + (self.matrix * np.log2(np.maximum(self.matrix, 1e-12))).sum(1)).sum())


def _windows(seq: str, width: int) -> np.ndarray:
    """Codes of all windows of A, C, G and T."""
    x = codes(seq)
    if len(x) < width:
        return np.zeros((0, width), np.int64)
    found = np.lib.stride_tricks.sliding_window_view(x, width)
    return found[(found < 4).all(1)].astype(np.int64)


def expected(seqs: list[str], models: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(counts, sites, likelihoods, sequences) of one E-step for each of several models: the expected letters at each
    place of sites, the expected number of sites, and the sum over sequences of the log ratio to the background.

    A sequence has one site, equally likely at each window, with the share's probability, and none otherwise."""
    k, width = models.shape[:2]
    counts, sites, likelihood, n = np.zeros((k, width, 4)), np.zeros(k), np.zeros(k), 0
    logs = np.log(np.maximum(models, 1e-300) / 0.25).reshape(k, width * 4)
    held: list[np.ndarray] = []
    size = 0
    for i, seq in enumerate(seqs):
        w = _windows(seq, width)
        if len(w):
            n += 1
            held.append(w)
            size += len(w)
        if not held or (size * k < CELLS and i < len(seqs) - 1):
            continue
        many = np.array([len(w) for w in held])
        begins = np.cumsum(many) - many
        letters = np.zeros((size, width * 4))
        letters[np.arange(size)[:, None], np.concatenate(held) + 4 * np.arange(width)] = 1
        held, size = [], 0
        score = logs @ letters.T  # models by the windows of several sequences
        top = np.maximum(np.maximum.reduceat(score, begins, axis=1), 0)
        each = np.exp(score - np.repeat(top, many, axis=1)) * (shares[:, None] / np.repeat(many, many))
        total = np.add.reduceat(each, begins, axis=1) + (1 - shares)[:, None] * np.exp(-top)
        z = each / np.repeat(total, many, axis=1)
        likelihood += (np.log(total) + top).sum(1)
        sites += z.sum(1)
        counts += (z @ letters).reshape(k, width, 4)
    return counts, sites, likelihood, n


def _round(rows: DataFrame, models: np.ndarray, shares: np.ndarray, fixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(models, shares, objectives) after one round over all sequences; objectives are those of the models given."""
    k, width = models.shape[:2]
    sent = rows.sparkSession.sparkContext.broadcast((models, shares))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, given = sent.value
        sums = np.zeros(k * (width * 4 + 3))
        for frame in frames:
            counts, sites, likelihood, n = expected(frame["seq"].tolist(), own, given)
            sums += np.concatenate([counts.ravel(), sites, likelihood, np.full(k, n)])
        yield pd.DataFrame({"at": np.arange(len(sums)), "value": sums})

    found = rows.mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(k * (width * 4 + 3))
    for r in found:
        sums[r.at] = r.value
    sent.unpersist()
    counts, (sites, likelihood, n) = sums[: k * width * 4].reshape(k, width, 4), sums[k * width * 4 :].reshape(3, k)
    objective = likelihood + PRIOR * np.log(np.maximum(models, 1e-300)).sum((1, 2))
    after = (counts + PRIOR) / (counts + PRIOR).sum(2, keepdims=True)
    return after, shares if fixed else np.clip(sites / np.maximum(n, 1), 1e-6, 1 - 1e-6), objective


def discover(df: DataFrame, id: str, seq: str, width: int = 8, sites: str = "zoops", iterations: int = 20, starts: int = 12, seed: int = 1) -> Motif | None:
    """The best motif of sequences: none or one site in each (``zoops``), or one in each (``oops``).

    Begins with the windows of ``starts`` sequences chosen by a seeded hash (MODELS of them at most); the most likely ones
    go on together for a few rounds, and the best to the end. What comes to the driver in a round is a matrix of expected counts for each task and model.
    The objective, the log likelihood ratio with the prior of the letters, never falls. Letters other than A, C, G, T cut
    windows; null and shorter sequences have none. None without a window."""
    if sites not in ("zoops", "oops"):
        raise ValueError(sites)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes are much work
    rows = materialized(df.select(F.col(id).cast("string").alias("id"), F.upper(F.col(seq)).alias("seq")).where(F.length("seq") >= width).repartition(parts))
    mix = F.xxhash64(F.lit(seed), "id", "seq")
    first = rows.select("seq", mix.alias("h")).orderBy("h", "seq").limit(starts).collect()
    begun = []
    for r in first:
        for w in _windows(r.seq, width)[: MODELS // starts]:
            one = np.full((width, 4), 0.1)
            one[np.arange(width), w] = 0.7
            begun.append(one)
    if not begun:
        return None
    seqs, models = rows.select("seq"), np.stack(begun)
    fixed = sites == "oops"
    shares = np.full(len(models), 1 - 1e-6 if fixed else 0.5)
    history: list[np.ndarray] = []
    for i in range(min(6, iterations)):
        number = len(models)
        models, shares, objective = _round(seqs, models, shares, fixed)
        if i in (1, 2):  # the most likely tenth after a round, then of those the best eight
            kept = np.argsort(-objective, kind="stable")[: max(8, number // 10) if i == 1 else 8]
            models, shares, objective, history = models[kept], shares[kept], objective[kept], [h[kept] for h in history]
        history.append(objective)
    best = int(np.argmax(history[-1])) if history else 0
    model, share, past = models[best : best + 1], shares[best : best + 1], [float(h[best]) for h in history]
    for _ in range(iterations - len(history)):
        model, share, objective = _round(seqs, model, share, fixed)
        past.append(float(objective[0]))
        if len(past) > 1 and past[-1] - past[-2] < 1e-9 * abs(past[-1]):
            break
    return Motif(model[0], float(share[0]), tuple(past))


def motif_rows(found: Motif | None, df: DataFrame) -> DataFrame:
    """(position, a, c, g, t, consensus, information, share, objective), a row for each place of a motif."""
    schema = "position int, a double, c double, g double, t double, consensus string, information double, share double, objective double"
    rows = [] if found is None else [(i, *map(float, row), found.consensus, found.information, found.share, found.history[-1]) for i, row in enumerate(found.matrix)]
    return df.sparkSession.createDataFrame(rows, schema)
