"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes.  The network labels every
byte of every segment, and a document's probability of a language is the mean
over all its bytes.  Weights are learned in numpy by backpropagation through
time from a bounded sample: at most ``per_language`` documents of each language,
however many languages there are, and ``segments_each`` segments of each
document, spread over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neural import Adam, column_sums, f32, fold, gru_backward, gru_forward, gru_params, uniform
from .storage import small_batches

SEGMENT = 64
HIDDEN = 8
PAD = 256
PER_LANGUAGE = 400
FIT_SEGMENTS = 12
ROUNDS = 320
BATCH = 256
WIDE = 1024


def segments(text: str) -> np.ndarray:
    """The UTF-8 bytes of the whole text in rows of SEGMENT, padded with PAD."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int16)
    rows = -(-len(raw) // SEGMENT)
    out = np.full(rows * SEGMENT, PAD, np.int16)
    out[: len(raw)] = raw
    return out.reshape(rows, SEGMENT)


def train(ids: np.ndarray, y: np.ndarray, classes: int, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """ids (n, SEGMENT) bytes, y (n) class of each segment."""
    rng = np.random.default_rng(seed)
    p = gru_params(rng, HIDDEN) | {"X": uniform(rng, 2, 3 * HIDDEN, PAD + 1, scale=0.3), "W": uniform(rng, 2, classes, HIDDEN), "b": np.zeros((classes, 1), f32)}
    adam = Adam(p, 0.02)
    order = np.empty(0, np.int64)
    size = min(BATCH, len(ids))
    for k in range(rounds):
        adam.rate = 0.02 * (1 - 0.9 * k / rounds)
        if len(order) < size:
            order = np.r_[order, rng.permutation(len(ids))]
        own, order = order[:size], order[size:]
        seq, target = ids[own].T.astype(np.int64), y[own]
        mask = (seq != PAD).astype(f32)
        weight = mask / max(1.0, float(mask.sum()))

        def gates(t: int, out: np.ndarray, seq=seq) -> None:
            out[0] = p["X"][0][:, seq[t]]
            out[1] = p["X"][1][:, seq[-1 - t]]

        saved, hs = [], np.empty((SEGMENT, 2, HIDDEN, size), f32)
        for t, h, s in gru_forward(p, gates, SEGMENT, size, True):
            saved.append(s)
            hs[t] = h
        at = np.stack([hs[:, 0], hs[::-1, 1]], axis=1)  # by position
        logits = np.einsum("dch,tdhb->tcb", p["W"], at) + p["b"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        d = prob
        d[:, target, np.arange(size)] -= 1
        d *= weight[:, None, :]
        grads = {"W": np.einsum("tcb,tdhb->dch", d, at), "b": d.sum(axis=(0, 2))[:, None]}
        dh = np.einsum("dch,tcb->tdhb", p["W"], d)
        more, dx = gru_backward(p, saved, lambda t, dh=dh: np.stack([dh[t, 0], dh[SEGMENT - 1 - t, 1]]))
        dx = np.stack(dx)  # steps, direction, gate, batch
        grads |= more
        grads["X"] = np.stack([column_sums(dx[:, k].transpose(1, 0, 2).reshape(3 * HIDDEN, -1), s.ravel(), PAD + 1) for k, s in enumerate((seq, seq[::-1]))])
        adam.step(grads)
    return p


def position_probabilities(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Probability of each class at each byte: (classes, n, SEGMENT)."""
    n, classes = len(ids), p["W"].shape[1]
    seq = np.ascontiguousarray(ids.T).astype(np.intp)
    out = np.zeros((SEGMENT, classes, n), f32)

    def gates(t: int, x: np.ndarray) -> None:
        np.take(p["X"][0], seq[t], axis=1, out=x[0], mode="clip")
        np.take(p["X"][1], seq[SEGMENT - 1 - t], axis=1, out=x[1], mode="clip")

    for t, h, _ in gru_forward(p, gates, SEGMENT, n, False):
        both = p["W"] @ h
        out[t] += both[0]
        out[SEGMENT - 1 - t] += both[1]
    out += p["b"]
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out.transpose(1, 2, 0)


def segment_sums(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Sum of each segment's position probabilities, padding left out: (n, classes)."""
    parts = []
    for at in range(0, len(ids), WIDE):
        own = ids[at : at + WIDE]
        prob = position_probabilities(p, own)
        prob *= own != PAD
        parts.append(prob.sum(axis=2).T)
    return np.concatenate(parts) if parts else np.empty((0, p["W"].shape[1]), f32)


def _fit_rows(segments_each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                seg = segments(text)
                if len(seg):
                    pick = np.unique(np.linspace(0, len(seg) - 1, min(segments_each, len(seg))).astype(int))
                    rows += [(doc_id, lang, int(k), seg[k].tobytes()) for k in pick]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "k", "seg"])

    return run


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, mod: int = 4, out: int = 2) -> DataFrame:
    """(doc_id, lang, text) of at most ``per_language`` documents of every language outside the held-out fold, by a hash of their id.

    One scan ranks ids without texts, and each task keeps only its first ones;
    another reads the chosen texts.  Of different texts under one doc_id and
    lang the first in order counts.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (fold("doc_id", mod) != out))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    # At most per_language rows for each language.
    rows = known.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, segments_each: int = FIT_SEGMENTS, mod: int = 4, out: int = 2) -> tuple[dict, list[str]]:
    """Learns from the ``sample``; returns weights and language names."""
    rows = sample(docs, per_language, mod, out).mapInPandas(_fit_rows(segments_each), "doc_id long, lang string, k long, seg binary")
    pdf = rows.toPandas().sort_values(["doc_id", "k", "lang", "seg"], ignore_index=True)
    names = sorted(pdf["lang"].unique())
    if not names:
        return {}, []
    ids = np.stack([np.frombuffer(s, np.int16) for s in pdf["seg"]])
    return train(ids, pdf["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), len(names)), names


def _predictor(p: dict, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            plain = [t is None or not any(map(str.isalpha, t)) for t in texts]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            held: list[np.ndarray] = []
            todo = [k for k in range(len(texts)) if not plain[k] and names]
            sums = np.zeros((len(texts), len(names)))
            owner: list[np.ndarray] = []
            size = 0
            for k in todo:
                seg = segments(texts[k])
                held.append(seg)
                owner.append(np.full(len(seg), k))
                size += len(seg)
                if size >= 16 * WIDE or k == todo[-1]:
                    got, own = segment_sums(p, np.concatenate(held)), np.concatenate(owner)
                    for c in range(len(names)):
                        sums[:, c] += np.bincount(own, got[:, c], len(texts))
                    held, owner, size = [], [], 0
            for k in todo:
                best = int(sums[k].argmax())
                langs[k], scores[k] = names[best], min(1.0, sums[k, best] / sums[k].sum())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return run


def predict(docs: DataFrame, model: tuple[dict, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of each row.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language could be learned.  Ties fall to the language first by name.
    Repeated rows are all returned; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(_predictor(*model), "doc_id long, lang_pred string, score double")
