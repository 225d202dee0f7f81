"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 7).

A word enters as a hashed word vector beside the mean of its hashed character trigram vectors. Forward and backward
gated recurrent units read windows of words that overlap by half; attention pools a window's states into one logit.
A text's score is that of its highest window. Everything is numpy: training on the driver, on a bounded sample of
labelled rows, and scoring in the executors, in batches of windows.
"""

from __future__ import annotations
from itertools import islice


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .words import split_words

#: Words of a window and between the starts of two.
WINDOW, STRIDE = 16, 8
WORDS, GRAMS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 1 << 12, 8, 8, 8
#: Rows learned of each label, and characters of the longest: the bounds of the sample.
PER_LABEL, LONGEST = {0: 3000, 1: 1500}, 100_000
EPOCHS, LEAST_STEPS, BATCH, PER_TEXT, RATE = 6, 300, 256, 8, 0.01
#: Words whose inputs a worker keeps, and windows scored at once.
MEMO, STEP = 200_000, 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Codes:
    """Distinct words as hashed rows: one of the word, and those of its character trigrams, word ends included."""

    def __init__(self, word: np.ndarray, gram: np.ndarray, size: np.ndarray):
        self.word, self.gram, self.size = word, gram, size
        self.low = np.cumsum(size) - size

    @classmethod
    def of(cls, words: list[bytes]) -> Codes:
        raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))  # with both marks, as many trigrams as bytes
        at = np.arange(size.sum()) + 2 * np.repeat(np.arange(len(words)), size)
        three = raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]
        gram = three * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAMS.bit_length() + 1)
        return cls(np.fromiter((h % WORDS for h in map(xxhash.xxh64_intdigest, words)), np.int64, len(words)), gram.astype(np.int64), size)

    def take(self, i: np.ndarray) -> Codes:
        size = self.size[i]
        flat = np.repeat(self.low[i] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Codes(self.word[i], self.gram[flat], size)


def windows_of(n: int, base: int = 0) -> np.ndarray:
    """Rows of word positions: all windows of a text of n words (at least 1); -1 beyond its end."""
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    if n > WINDOW:
        starts[-1] = min(starts[-1], n - WINDOW)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at + base, -1)


class Network:
    def __init__(self, seed: int = 7):
        self.learned = False
        rng = np.random.default_rng(seed)
        d, h = 2 * WIDTH, HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(WORDS, WIDTH, scale=0.1), "gram": draw(GRAMS, WIDTH, scale=0.1)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * h, scale=d**-0.5), f"U{way}": draw(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, ATTENTION, scale=0.3), "a": draw(ATTENTION, scale=0.3), "o": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}

    def inputs(self, codes: Codes) -> np.ndarray:
        """Word vectors beside mean trigram vectors of distinct words."""
        mean = np.add.reduceat(self.p["gram"][codes.gram], codes.low) / codes.size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][codes.word], mean], 1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word sends to the gates of either direction."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def forward(self, g: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows; ``rows`` holds the row of ``g`` of each word, -1 beyond the end."""
        n, size = rows.shape
        h, real = HIDDEN, rows >= 0
        full = bool(real.all())
        states = np.empty((size, n, 2 * h), np.float32)
        steps = {}
        for way, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            u, last = self.p[f"U{way}"], np.zeros((n, h), np.float32)
            low = 0 if way == "f" else 3 * h
            for t in order:
                x, r = g[rows[:, t], low : low + 3 * h], last @ u
                zr = sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
                z, reset = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
                now = new + z * (last - new)
                if not full:
                    now = np.where(real[:, t, None], now, last)
                if keep:
                    steps[way, t] = (last, z, reset, new, r[:, 2 * h :])
                states[t, :, low // 3 : low // 3 + h] = now
                last = now
        hidden = np.tanh(states @ self.p["A"])
        e = hidden @ self.p["a"]
        if not full:
            e = np.where(real.T, e, np.float32(-30))
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logit = pooled @ self.p["o"] + self.p["bias"][0]
        return (logit, states, steps, hidden, weight, pooled, real) if keep else logit

    def gradients(self, codes: Codes, rows: np.ndarray, target: np.ndarray, cost: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted logistic loss by back-propagation through time."""
        x = self.inputs(codes)
        g = self.gates(x)
        logit, states, steps, hidden, weight, pooled, real = self.forward(g, rows, keep=True)
        prob = sigmoid(logit)
        loss = float(-(cost * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum())
        d_logit = cost * (prob - target)
        grad = {"o": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnd,nd->tn", states, d_pooled)
        d_e = weight * (d_weight - (weight * d_weight).sum(0)) * real.T
        grad["a"] = np.einsum("tn,tnk->k", d_e, hidden)
        d_hidden = d_e[:, :, None] * self.p["a"] * (1 - hidden**2)
        grad["A"] = np.einsum("tnd,tnk->dk", states, d_hidden)
        d_states = d_states + d_hidden @ self.p["A"].T
        n, size = rows.shape
        h = HIDDEN
        d_g = np.zeros_like(g)
        for way, order in (("f", range(size - 1, -1, -1)), ("b", range(size))):
            low, u = (0 if way == "f" else 3 * h), self.p[f"U{way}"]
            d_u, d_last = np.zeros_like(u), np.zeros((n, h), np.float32)
            for t in order:
                last, z, reset, new, rn = steps[way, t]
                d = d_states[t, :, low // 3 : low // 3 + h] + d_last
                m = real[:, t, None]
                d_now = np.where(m, d, np.float32(0))
                d_new = d_now * (1 - z) * (1 - new**2)
                d_z = d_now * (last - new) * z * (1 - z)
                d_r = d_new * rn * reset * (1 - reset)
                d_in = np.concatenate([d_z, d_r, d_new], 1)
                d_rec = np.concatenate([d_z, d_r, d_new * reset], 1)
                d_u += last.T @ d_rec
                np.add.at(d_g[:, low : low + 3 * h], np.maximum(rows[:, t], 0), d_in)
                d_last = d_rec @ u.T + d_now * z + np.where(m, np.float32(0), d)
            grad[f"U{way}"] = d_u
            grad[f"W{way}"], grad[f"c{way}"] = x.T @ d_g[:, low : low + 3 * h], d_g[:, low : low + 3 * h].sum(0)
        d_x = d_g[:, : 3 * h] @ self.p["Wf"].T + d_g[:, 3 * h :] @ self.p["Wb"].T
        grad["word"], grad["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(grad["word"], codes.word, d_x[:, :WIDTH])
        np.add.at(grad["gram"], codes.gram, np.repeat(d_x[:, WIDTH:] / codes.size[:, None].astype(d_x.dtype), codes.size, axis=0))
        return grad, loss


def fit(rows: pd.DataFrame, seed: int = 7) -> Network:
    """A network trained on rows (text, label).

    A label says that some window of the text is toxic, not which. The first epochs take random windows of each
    text; from then on a toxic text is represented by its windows of highest score, and others by random windows
    and their highest. Each text weighs the same. A small sample takes more epochs, to make up LEAST_STEPS steps.
    Without rows of both labels there is nothing to tell toxic texts by, and every text has the score 0.
    """
    rng, net = np.random.default_rng(seed), Network(seed)
    ids: dict[bytes, int] = {}
    coded, known = [], []
    for text, y in zip(rows.text, rows.label, strict=True):  # words are numbered at once: their lists would take most of the memory
        if words := split_words(text):
            coded.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int32))
            known.append(int(y))
    if len(set(known)) < 2:
        return net
    net.learned = True
    codes = Codes.of(list(ids))
    every = [np.where(win >= 0, c[np.maximum(win, 0)], -1) for c in coded for win in [windows_of(len(c))]]
    label = np.array(known, np.float32)
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS * BATCH // (PER_TEXT * len(coded))))
    for epoch in range(epochs):
        picked = [rng.permutation(len(w))[:PER_TEXT] for w in every]
        if epoch >= epochs // 3:
            g = net.gates(net.inputs(codes))
            flat = np.concatenate(every)
            scores = np.concatenate([net.forward(g, flat[i : i + STEP]) for i in range(0, len(flat), STEP)])
            ends = np.cumsum([len(w) for w in every])
            for i, w in enumerate(every):
                own = scores[ends[i] - len(w) : ends[i]]
                best = np.argsort(-own, kind="stable")[: 1 if label[i] else PER_TEXT // 2]
                picked[i] = best if label[i] else np.union1d(best, picked[i][: PER_TEXT // 2])
        doc = np.repeat(np.arange(len(every)), [len(x) for x in picked])
        wins = np.concatenate([w[x] for w, x in zip(every, picked, strict=True)])
        cost = np.repeat(1 / np.array([len(x) for x in picked]), [len(x) for x in picked]).astype(np.float32)
        for at in np.array_split(rng.permutation(len(wins)), max(1, len(wins) // BATCH)):
            used, own = np.unique(wins[at], return_inverse=True)
            local = own.reshape(wins[at].shape) - (used[0] < 0)
            grad, _ = net.gradients(codes.take(used[used >= 0]), local, label[doc[at]], cost[at] / cost[at].sum())
            step += 1
            for k, v in grad.items():
                first[k] += np.float32(0.1) * (v - first[k])
                second[k] += np.float32(0.001) * (v * v - second[k])
                net.p[k] -= np.float32(RATE * (1 - 0.7 * epoch / epochs)) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.999**step)) + np.float32(1e-6))
    return net


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Scorer:
    """Scores texts; keeps the gate inputs of words it has met, up to MEMO of them."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbers()
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        known = len(self.ids)
        if known > MEMO:
            self.clear()
            known = 0
        ids = self.ids
        rows = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if len(ids) > known:
            while len(self.gates) < len(ids):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            fresh = list(islice(reversed(ids), len(ids) - known))[::-1]
            for at in range(0, len(fresh), 4096):
                part = fresh[at : at + 4096]
                self.gates[known + at : known + at + len(part)] = self.net.gates(self.net.inputs(Codes.of(part)))
        return rows

    def scores(self, texts: list[str | None]) -> list[float]:
        out = np.zeros(len(texts))
        if not self.net.learned:
            return out.tolist()
        top = np.full(len(texts), -np.inf)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal held
            if waiting:
                wins, doc = np.concatenate([w for w, _ in waiting]), np.concatenate([d for _, d in waiting])
                for at in range(0, len(wins), STEP):
                    np.maximum.at(top, doc[at : at + STEP], self.net.forward(self.gates, wins[at : at + STEP]))
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            words = split_words(text)
            if not words:
                continue
            known = len(self.ids)
            if known > MEMO:
                flush()
            rows = self.rows_of(words)
            at = windows_of(len(words))
            waiting.append((np.where(at >= 0, rows[np.maximum(at, 0)], -1), np.full(len(at), i)))
            held += len(at)
            if held >= STEP:
                flush()
        flush()
        some = top > -np.inf
        out[some] = 1 / (1 + np.exp(-np.clip(top[some], -30, 30)))
        return out.tolist()


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the toxicity of each whole text, 0 to 1: that of its highest window.

    Null texts and texts without words have 0. Repeated rows are scored each; a column named like the output is
    replaced. The network, of fixed size, is broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)

    def start():
        scorer = Scorer(sent.value)
        return lambda texts: (scorer.scores(texts),)

    return map_texts(df, text, {out: T.DoubleType()}, start, keep)
