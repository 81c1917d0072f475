"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is read as words.  A word enters as a learned word vector next to the
sum of its learned character vectors, one for each run of ``GRAM_SIZES``
characters of ``<word>``.  Only words and runs whose document counts in the
sample differ between the labels (|z| of ``LEAST_Z`` or more) have a vector, so
rare words can't be learned by heart; all other words share one plain input.
A word of more than ``PIECE`` characters is read whole as well: parts between
its punctuation count as words, and what is longer still (unsegmented scripts)
becomes pieces that overlap so far that each character run lies in one of them.
Windows of ``WINDOW`` words start at every word of the text (at every
``STRIDE``-th for the learning sample); attention weighs the recurrent states of a window.  A document's score is
a logistic function of its most toxic window, of the mean over its windows and
of their product, fitted on a third of the sample that the network did not see:
one doubtful word in a long text weighs less than in a short one.  Equal windows
are computed once.

Labels belong to documents, so learning alternates: score every window of the
sample, take the most toxic windows of toxic documents as positive, and the
most toxic and some other windows of the rest as negative.  The sample is
bounded: at most ``per_class`` documents of each label, and ``windows_each``
windows spread over the whole text of each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neural import Adam, column_sums, even_product, f32, gru_backward, gru_forward, gru_params, labelled_sample, uniform
from .storage import small_batches

WINDOW, STRIDE = 32, 24
HIDDEN, ATTEND = 8, 8
WORDS, GRAMS, WIDTH = 1024, 4096, 8
GRAM_SIZES, GRAM_BITS = (4, 5, 6, 7), 22
PIECE, CUT = 64, "\0"  # CUT marks an end of a piece that is no end of a word
LEAST_Z, LEAST_DOCS = 4.5, 5
PER_CLASS, FIT_WINDOWS = 1500, 24
EPOCHS, STEPS, BATCH = 5, 90, 192
WIDE, BLOCK = 1024, 32_768
MOST_PARTS = 60_000
LEVEL = 0.7
_STRIP = re.compile(r"^\W+|\W+$")
_JOINTS = re.compile(r"[\W_]+")
PAD = 0  # word 0 of a vocabulary is the padding
MIX = np.random.default_rng(5).integers(1, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def split(text: str | None) -> list[str]:
    """The words of a text; one longer than ``PIECE`` becomes its parts between punctuation, or overlapping pieces."""
    words = (text or "").replace(CUT, " ").split()
    if not words or max(map(len, words)) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) <= PIECE:
            out.append(word)
            continue
        for part in _JOINTS.split(word):
            step = PIECE - max(GRAM_SIZES) + 1
            last = max(0, -(-(len(part) - PIECE) // step))
            for k in range(last + 1 if part else 0):
                out.append((CUT if k else "") + part[k * step : k * step + PIECE] + (CUT if k < last else ""))
    return out


def bare(word: str) -> str:
    return _STRIP.sub("", word.lower())


def marked(word: str) -> str:
    """The bare form between the marks of its ends; an end that is a cut has none."""
    return ("" if word[:1] == CUT else "<") + bare(word) + ("" if word[-1:] == CUT else ">")


def runs(c: str) -> list[str]:
    """Character runs of a marked form."""
    return [c[i : i + n] for n in GRAM_SIZES for i in range(len(c) - n + 1)]


def telling(with_0: np.ndarray, with_1: np.ndarray, n0: int, n1: int, most: int) -> np.ndarray:
    """Indices of features whose share of documents differs between the labels, most telling first."""
    known = np.flatnonzero(with_0 + with_1 >= LEAST_DOCS)
    a, b = with_0[known], with_1[known]
    p = (a + b + 1) / (n0 + n1 + 2)
    z = np.abs(b / n1 - a / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    order = np.lexsort((known, -z))[:most]
    return known[order[z[order] >= LEAST_Z]]


def lexicon(forms: list[str], docs: list[np.ndarray], y: np.ndarray) -> dict[str, dict[str, int]]:
    """Row of each telling word and character run; row 0 is for all others.

    forms: distinct marked forms in order; docs: the places in it of each document's own, each once.
    """
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    sizes = np.array([sum(max(0, len(w) - n + 1) for n in GRAM_SIZES) for w in forms], np.int64)
    ends = np.r_[0, np.cumsum(sizes)]
    spell = (zlib.crc32(r.encode("utf-8", "replace")) & ((1 << GRAM_BITS) - 1) for w in forms for r in runs(w))
    hashes, spell = np.unique(np.fromiter(spell, np.int32, int(ends[-1])), return_inverse=True)
    word_n = np.zeros((2, len(forms)), np.int32)
    run_n = np.zeros((2, len(hashes)), np.int32)
    for at, label in zip(docs, y.tolist()):
        word_n[label, at] += 1
        flat = np.repeat(ends[at + 1] - np.cumsum(sizes[at]), sizes[at]) + np.arange(sizes[at].sum())
        run_n[label, np.unique(spell[flat])] += 1
    best = telling(word_n[0], word_n[1], n0, n1, WORDS - 1)
    rows = {forms[k][1:-1]: i + 1 for i, k in enumerate(best.tolist()) if len(forms[k]) > 2 and forms[k][0] + forms[k][-1] == "<>"}
    chosen = np.zeros(len(hashes), bool)
    chosen[telling(run_n[0], run_n[1], n0, n1, GRAMS - 1)] = True
    chosen = chosen[spell]
    grams: dict[str, int] = {}
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(chosen), "right") - 1).tolist():
        for r, ok in zip(runs(forms[k]), chosen[ends[k] : ends[k + 1]].tolist()):
            if ok and len(grams) < GRAMS - 1:
                grams.setdefault(r, len(grams) + 1)
    return {"words": rows, "runs": grams}


class Vocabulary:
    """Words seen so far; words without a telling part share the id 1."""

    MOST_WORDS = 400_000

    def __init__(self, rows: dict[str, dict[str, int]]):
        import ahocorasick

        self.rows = rows
        self.auto = ahocorasick.Automaton()
        for r, k in rows["runs"].items():
            self.auto.add_word(r, k)
        self.auto.make_automaton()
        self.parts: list[tuple[int, list[int]]] = [(0, []), (0, [])]
        self.known: dict[tuple, int] = {(0, ()): 1}
        self.index: dict[str, int] = {}

    def _id(self, word: str) -> int:
        w = "" if CUT in word else bare(word)
        grams = sorted(k for _, k in self.auto.iter(marked(word))) if len(self.auto) else []
        part = (self.rows["words"].get(w, 0), tuple(grams))
        k = self.known.get(part)
        if k is None:
            k = self.known[part] = len(self.parts)
            self.parts.append((part[0], grams))
        self.index[word] = k
        return k

    def ids(self, words: list[str]) -> np.ndarray:
        got = list(map(self.index.get, words))
        if None in got:
            got = [self._id(w) if g is None else g for w, g in zip(words, got)]
            if len(self.index) > self.MOST_WORDS:
                self.index.clear()
        return np.array(got, np.int64)

    def inputs(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lexicon row of each id from ``start`` on, and flat character rows with their owners."""
        own = self.parts[start:]
        word = np.array([w for w, _ in own], np.int64)
        grams = np.array([g for _, gs in own for g in gs], np.int64)
        return word, grams, np.repeat(np.arange(len(own)), [len(gs) for _, gs in own])


def windows(ids: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Overlapping windows over all ids, the last ones padded: (n, WINDOW)."""
    n = max(1, -(-max(0, len(ids) - WINDOW) // stride) + 1)
    padded = np.full((n - 1) * stride + WINDOW, PAD, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::stride]


class Network:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        p = gru_params(rng, HIDDEN) | {
            "E": uniform(rng, WIDTH, WORDS, scale=0.3) * (np.arange(WORDS) > 0), "C": uniform(rng, WIDTH, GRAMS, scale=0.3),
            "X": uniform(rng, 2, 3 * HIDDEN, 2 * WIDTH), "bx": np.zeros((2, 3 * HIDDEN, 1), f32),
            "A": uniform(rng, ATTEND, 2 * HIDDEN), "ba": np.zeros((ATTEND, 1), f32), "v": uniform(rng, 1, ATTEND),
            "c": uniform(rng, 1, 2 * HIDDEN), "d": np.zeros((1, 1), f32),
        }
        return cls(p)

    def embed(self, word: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = np.sqrt(np.maximum(np.bincount(owner, minlength=len(word)), 1)).astype(f32)
        chars = column_sums(self.p["C"][:, grams], owner, len(word)) / many
        return np.concatenate([self.p["E"][:, word], chars]), many

    def table(self, inputs: tuple) -> np.ndarray:
        """Input gates of each word: (2, 3H, words)."""
        return even_product(self.p["X"], self.embed(*inputs)[0]) + self.p["bx"]

    def forward(self, table: np.ndarray, seq: np.ndarray, keep: bool) -> tuple:
        """seq (WINDOW, n) of columns of ``table``; returns the logit of each window and what backward needs.

        Unless kept for backward, a window's logit does not depend on the others (n of 2 or more).
        """
        n = seq.shape[1]
        product = np.matmul if keep else even_product

        def gates(t: int, out: np.ndarray) -> None:
            np.take(table[0], seq[t], axis=1, out=out[0], mode="clip")
            np.take(table[1], seq[WINDOW - 1 - t], axis=1, out=out[1], mode="clip")

        at, saved = np.empty((WINDOW, 2, HIDDEN, n), f32), []
        for t, h, s in gru_forward(self.p, gates, WINDOW, n, keep, product):
            at[t, 0], at[WINDOW - 1 - t, 1] = h[0], h[1]
            saved.append(s)
        at = at.reshape(WINDOW, 2 * HIDDEN, n)
        u = product(self.p["A"], at)
        u += self.p["ba"]
        np.tanh(u, out=u)
        e = product(self.p["v"], u)[:, 0]
        e[seq == PAD] = -30.0
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        pooled = (at * e[:, None]).sum(axis=0)
        logit = (product(self.p["c"], pooled) + self.p["d"])[0]
        return logit, (at, u, e, pooled, saved)

    def gradients(self, inputs: tuple, seq: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        emb, many = self.embed(*inputs)
        table = p["X"] @ emb + p["bx"]
        logit, (at, u, e, pooled, saved) = self.forward(table, seq, True)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(f32)[None]
        g = {"c": d @ pooled.T, "d": d.sum(keepdims=True)}
        dp = p["c"].T @ d
        da = (at * dp).sum(axis=1)
        de = e * (da - (e * da).sum(axis=0))
        de[seq == PAD] = 0
        g["v"] = np.einsum("tb,tab->a", de, u)[None]
        du = p["v"].T[None] * de[:, None] * (1 - u * u)
        g["A"], g["ba"] = np.einsum("tab,thb->ah", du, at), du.sum(axis=(0, 2))[:, None]
        dh = (e[:, None] * dp + p["A"].T @ du).reshape(WINDOW, 2, HIDDEN, -1)
        more, dx = gru_backward(p, saved, lambda t: np.stack([dh[t, 0], dh[WINDOW - 1 - t, 1]]))
        dx = np.stack(dx)
        flat = [column_sums(dx[:, k].transpose(1, 0, 2).reshape(3 * HIDDEN, -1), s.ravel(), table.shape[2]) for k, s in enumerate((seq, seq[::-1]))]
        dt = np.stack(flat)
        g |= more | {"X": dt @ emb.T, "bx": dt.sum(axis=2, keepdims=True)}
        demb = (p["X"].transpose(0, 2, 1) @ dt).sum(axis=0)
        word, grams, owner = inputs
        g["E"] = column_sums(demb[:WIDTH], word, WORDS) * (np.arange(WORDS) > 0)
        g["C"] = column_sums((demb[WIDTH:] / many)[:, owner], grams, GRAMS)
        return g

    def scores(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = (ids.astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        ids = ids[np.r_[first, first[:1]] if len(first) % WIDE == 1 else first]  # no block of one window
        out = np.empty(len(ids), f32)
        for at in range(0, len(ids), WIDE):
            seq = np.ascontiguousarray(ids[at : at + WIDE].T)
            out[at : at + WIDE] = self.forward(table, seq, False)[0]
        return (1 / (1 + np.exp(-out)))[back]


def train(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, vocab: Vocabulary, seed: int = 11) -> Network:
    """ids (n, WINDOW), doc (n) owner of each window, y label of each document."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    if len(set(y[doc].tolist())) < 2:
        net.p["c"][:], net.p["d"][:] = 0, (20.0 if len(doc) and y[doc[0]] else -20.0)
        return net
    word, grams, owner = vocab.inputs()
    ends = np.searchsorted(owner, np.arange(len(word) + 1))
    adam = Adam(net.p, 0.02)
    positive = y[doc] == 1
    clean = np.flatnonzero(~positive)
    for epoch in range(EPOCHS):
        if epoch == 0:
            pos, neg = np.flatnonzero(positive), clean
        else:
            s = net.scores(net.table((word, grams, owner)), ids)
            order = np.lexsort((-s, doc))
            rank = np.empty(len(s), np.int64)
            first = np.r_[True, doc[order][1:] != doc[order][:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
            rank[order] = np.arange(len(s)) - start
            pos = np.flatnonzero(positive & ((rank == 0) | (s > 0.5)))
            hard = clean[np.argsort(-s[clean], kind="stable")[: max(BATCH, len(clean) // 8)]]
            neg = np.r_[clean, np.repeat(hard, 3)]
        for k in range(STEPS):
            adam.rate = 0.02 * (1 - 0.95 * (epoch * STEPS + k) / (EPOCHS * STEPS))
            own = np.r_[rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)]
            used, seq = np.unique(np.r_[PAD, ids[own].ravel()], return_inverse=True)
            seq = seq[1:].reshape(-1, WINDOW).T
            parts = [np.arange(ends[w], ends[w + 1]) for w in used]
            flat = np.concatenate(parts)
            sub = (word[used], grams[flat], np.repeat(np.arange(len(used)), [len(x) for x in parts]))
            adam.step(net.gradients(sub, np.ascontiguousarray(seq), y[doc[own]].astype(f32)))
    return net


def _fit_rows(windows_each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, y in zip(pdf["doc_id"], pdf["text"], pdf["y"]):
                words = split(text)
                starts = np.arange(max(1, -(-max(0, len(words) - WINDOW) // STRIDE) + 1)) * STRIDE
                pick = starts[np.unique(np.linspace(0, len(starts) - 1, min(windows_each, len(starts))).astype(int))]
                rows += [(doc_id, y, int(k), " ".join(words[k : k + WINDOW])) for k in pick]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "k", "words"])

    return run


Model = tuple[dict[str, np.ndarray], dict[str, dict[str, int]]]


def pool(doc: np.ndarray, s: np.ndarray, docs: int) -> np.ndarray:
    """(docs, 4): constant, highest window score, mean window score and their product."""
    top = np.zeros(docs)
    np.maximum.at(top, doc, s)
    mean = np.bincount(doc, s, docs) / np.maximum(np.bincount(doc, minlength=docs), 1)
    return np.stack([np.ones(docs), top, mean, top * mean], axis=1)


def fit_pool(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge and equal weight for both labels, by Newton's steps."""
    if len(set(y.tolist())) < 2:
        return np.array([-5.0, 5.0, 5.0, 0.0])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.diag([0.0, 0.02, 0.02, 0.02])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge @ w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -4, 4)
    return w


def learn(pdf: pd.DataFrame) -> Model:
    """pdf: rows of ``_fit_rows``.  Returns the network's weights and the lexicon."""
    pdf = pdf.sort_values(["doc_id", "k", "words"], ignore_index=True)
    names, doc = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
    y = np.zeros(len(names), np.int64)
    y[doc] = pdf["y"].to_numpy()
    late = np.arange(len(names)) % 3 == 2  # these documents only fit the pooling
    index: dict[str, int] = {}  # each distinct word is held once; windows are numbers
    words = [np.array([index.setdefault(w, len(index)) for w in text.split()], np.int32) for text in pdf["words"]]
    form = list(map(marked, index))
    first = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
    seen = [np.unique(np.concatenate(words[a:b])) for a, b, o in zip(first[:-1].tolist(), first[1:].tolist(), late) if not o]
    forms = sorted({form[w] for own in seen for w in own.tolist()})
    place = {w: k for k, w in enumerate(forms)}
    at = np.array([place.get(w, -1) for w in form], np.int64)
    vocab = Vocabulary(lexicon(forms, [np.unique(at[own]) for own in seen], y[~late]))
    number = vocab.ids(list(index))
    ids = np.zeros((len(pdf), WINDOW), np.int64)
    for k, own in enumerate(words):
        ids[k, : len(own)] = number[own]
    early = ~late[doc]
    net = train(ids[early], doc[early], y, vocab)
    x = pool(doc, net.scores(net.table(vocab.inputs()), ids), len(names))
    use = late if len(set(y[late].tolist())) > 1 else ~late
    return net.p | {"pool": fit_pool(x[use], y[use])}, vocab.rows


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, windows_each: int = FIT_WINDOWS) -> Model:
    """Learns from a bounded sample of documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", per_class).mapInPandas(_fit_rows(windows_each), "doc_id long, y int, k long, words string")
    return learn(rows.toPandas())


class Scorer:
    """Scores whole texts; the gates of words met before are kept, up to a bound."""

    def __init__(self, model: Model):
        params, self.rows = model
        self.net, self.weights = Network(params), params["pool"]
        self._reset()

    def _reset(self) -> None:
        self.vocab = Vocabulary(self.rows)
        self.table = self.net.table(self.vocab.inputs())

    def _windows(self, held: list[np.ndarray]) -> np.ndarray:
        known = self.table.shape[2]
        if len(self.vocab.parts) > known:
            self.table = np.concatenate([self.table, self.net.table(self.vocab.inputs(known))], axis=2)
        return self.net.scores(self.table, np.concatenate(held))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        held, size, scored, many = [], 0, [], []
        for text in texts:
            own = windows(self.vocab.ids(split(text)), 1)
            many.append(len(own))
            for at in range(0, len(own), BLOCK):
                held.append(own[at : at + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    scored.append(self._windows(held))
                    held, size = [], 0
            if not held and len(self.vocab.parts) > MOST_PARTS:
                self._reset()
        if held:
            scored.append(self._windows(held))
        if len(self.vocab.parts) > MOST_PARTS:
            self._reset()
        x = pool(np.repeat(np.arange(len(texts)), many), np.concatenate(scored).astype(float), len(texts))
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(axis=1), -30, 30)))


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scorer(pdf["text"].tolist())})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row; a null or empty text is one window of padding and gets its score."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_score(model), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that score below ``level``, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer(batch.column("text").to_pylist()) < level))

    return docs.mapInArrow(run, docs.schema)
