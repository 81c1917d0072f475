"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words that cover its whole text.
Each passage is encoded (hashed word frequencies, word shapes, repetition inside
the passage and against the document so far) and passed through a hidden layer;
gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the hidden
vectors of a bag, and a logistic unit scores their weighted sum (Ilse et al.,
"Attention-based Deep Multiple Instance Learning", 2018).  Only document labels
are used.  The fit reads a bounded sample: at most ``per_class`` documents of
each label and ``passages_each`` passages spread over the whole text of each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neural import Adam, f32, labelled_sample, row_product, uniform
from .storage import small_batches

PASSAGE = 64
BUCKETS, SHAPES, EXTRA = 64, 10, 6
FEATURES = BUCKETS + SHAPES + EXTRA
HIDDEN, GATE = 16, 8
PER_CLASS, FIT_PASSAGES = 1500, 40
ROUNDS, RATE = 250, 0.02
MOST_WORDS = 300_000
_STRIP = re.compile(r"^\W+|\W+$")


def shape(word: str) -> int:
    if word.isalpha():
        return 0 if word.islower() else 1 if len(word) == 1 or not word.isupper() else 2
    tail = len(word) - len(word.rstrip(".,;:!?)»\"'"))
    core = word[: len(word) - tail] if tail else word
    if core.isalpha() and tail == 1:
        return 3 if not core.isupper() or len(core) == 1 else 4
    if core.isalpha():
        return 5
    if any(c.isdigit() for c in word):
        return 6 if len(word) < 16 else 7
    if not any(c.isalpha() for c in word):
        return 8
    return 9


class Words:
    """Per distinct word: an id and a packed code of bucket, shape and length."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.codes: list[int] = []

    def ids(self, words: list[str]) -> np.ndarray:
        got = list(map(self.index.get, words))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    w = words[k]
                    if w not in self.index:
                        self.index[w] = len(self.codes)
                        bucket = zlib.crc32(_STRIP.sub("", w.lower()).encode("utf-8", "replace")) % BUCKETS
                        self.codes.append(bucket | shape(w) << 8 | min(len(w), 255) << 16)
                    got[k] = self.index[w]
        return np.array(got, np.int64)


def encode(texts: list[str | None], words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (n, FEATURES) and the text each belongs to; a text without words has one zero passage."""
    words = words or Words()
    parts, owner, passage, n = [], [], [], 0
    fresh = []
    for k, text in enumerate(texts):
        own = words.ids((text or "").split())
        many = max(1, -(-len(own) // PASSAGE))
        owner.append(np.full(many, k))
        passage.append(n + np.arange(len(own)) // PASSAGE)
        parts.append(own)
        n += many
        # A word pair is fresh where the document first has it.
        pair = own[:-1] * (1 << 31) + own[1:]
        first = np.zeros(len(own), bool)
        if len(pair):
            first[np.unique(pair, return_index=True)[1]] = True
            first[-1] = True
        elif len(own):
            first[:] = True
        fresh.append(first)
    ids, at, new = np.concatenate(parts), np.concatenate(passage), np.concatenate(fresh)
    out = np.zeros((n, FEATURES), f32)
    code = np.array(words.codes, np.int64)[ids]
    size = np.maximum(np.bincount(at, minlength=n), 1)[:, None]
    out[:, :BUCKETS] = np.bincount(at * BUCKETS + (code & 255), minlength=n * BUCKETS).reshape(n, -1) / size * 8
    out[:, BUCKETS : BUCKETS + SHAPES] = np.bincount(at * SHAPES + (code >> 8 & 255), minlength=n * SHAPES).reshape(n, -1) / size * 3
    length = (code >> 16).astype(float)
    mean = np.bincount(at, length, n) / size[:, 0]
    distinct = np.unique(at * (len(words.codes) + 1) + ids)
    extra = out[:, BUCKETS + SHAPES :]
    extra[:, 0] = mean / 10
    extra[:, 1] = np.sqrt(np.maximum(0, np.bincount(at, length**2, n) / size[:, 0] - mean**2)) / 10
    extra[:, 2] = np.bincount(distinct // (len(words.codes) + 1), minlength=n) / size[:, 0]
    extra[:, 3] = np.bincount(at, new, n) / size[:, 0]
    extra[:, 4] = size[:, 0] / PASSAGE
    extra[:, 5] = 1
    return out, np.concatenate(owner)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, product: Callable = np.matmul) -> tuple:
    """Bags are consecutive rows of ``x``; returns each bag's logit and what backward needs."""
    h = np.tanh(product(x, p["W"]) + p["b"])
    t, s = np.tanh(product(h, p["V"])), sigmoid(product(h, p["U"]))
    e = product(t * s, p["w"])
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return product(z, p["c"]) + p["d"][0], (h, t, s, a, z)


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> dict[str, np.ndarray]:
    """x: passages sorted by owner; y: label of each owner.  Both labels weigh the same."""
    rng = np.random.default_rng(seed)
    p = {
        "W": uniform(rng, FEATURES, HIDDEN, scale=0.2), "b": np.zeros(HIDDEN, f32), "V": uniform(rng, HIDDEN, GATE),
        "U": uniform(rng, HIDDEN, GATE), "w": uniform(rng, GATE), "c": uniform(rng, HIDDEN), "d": np.zeros(1, f32),
    }
    if len(set(y.tolist())) < 2:
        p["c"][:], p["d"][:] = 0, (5.0 if len(y) and y[0] else -5.0)
        return p
    sizes = np.bincount(owner)
    starts = np.cumsum(sizes) - sizes
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(f32)
    adam = Adam(p, RATE)
    for k in range(rounds):
        adam.rate = RATE * (1 - 0.9 * k / rounds)
        logit, (h, t, s, a, z) = forward(p, x, starts, sizes)
        d = (sigmoid(logit) - y).astype(f32) * weight
        dz = d[:, None] * p["c"]
        dzr = np.repeat(dz, sizes, axis=0)
        da = (dzr * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        g = de[:, None] * p["w"]
        dt, ds = g * s * (1 - t * t), g * t * s * (1 - s)
        dh = (a[:, None] * dzr + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        adam.step(
            {
                "c": z.T @ d, "d": d.sum(keepdims=True), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds,
                "W": x.T @ dh + f32(1e-3) * p["W"], "b": dh.sum(axis=0),
            }
        )
    return p


def _fit_rows(passages_each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, owner = encode(pdf["text"].tolist())
            rows = []
            for k, (doc_id, y) in enumerate(zip(pdf["doc_id"], pdf["y"])):
                own = np.flatnonzero(owner == k)
                pick = own[np.unique(np.linspace(0, len(own) - 1, min(passages_each, len(own))).astype(int))]
                rows += [(doc_id, y, int(i - own[0]), x[i].tobytes()) for i in pick]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "k", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, passages_each: int = FIT_PASSAGES) -> dict[str, np.ndarray]:
    """Learns from a bounded sample of documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", per_class).mapInPandas(_fit_rows(passages_each), "doc_id long, y int, k long, x binary")
    pdf = rows.toPandas().sort_values(["doc_id", "k", "x"], ignore_index=True)
    if not len(pdf):
        return train(np.empty((0, FEATURES), f32), np.empty(0, np.int64), np.empty(0, np.int64))
    x = np.stack([np.frombuffer(b, f32) for b in pdf["x"]])
    names, owner = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
    y = np.zeros(len(names), np.int64)
    y[owner] = pdf["y"].to_numpy()
    return train(x, owner, y)


def scores(texts: list[str | None], p: dict[str, np.ndarray], words: Words | None = None) -> np.ndarray:
    x, owner = encode(texts, words)
    sizes = np.bincount(owner)
    return sigmoid(forward(p, x, np.cumsum(sizes) - sizes, sizes, row_product)[0].astype(float))


def _score(p: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scores(texts, p, words) if texts else []})
            if len(words.codes) > MOST_WORDS:
                words = Words()

    return run


def score(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) of each row; a null or empty text is one passage without words."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_score(p), "doc_id long, score double")
