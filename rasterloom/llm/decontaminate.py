"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Each document is scanned once for a block of the benchmark: its words become
   ids, and wherever it holds a word ``N``-gram of some item, the words around
   are kept, as far as an alignment there could reach.  Those passages are
   written; nothing else of the documents is read again.
2. The n-grams are counted over all documents.  In every stretch of ``WINDOW``
   consecutive n-grams of an item the rarest one becomes a seed (in a shorter
   item the rarest of all), so any copy that keeps such a stretch holds a seed,
   however common the passage itself is.  Further n-grams become seeds, rarest
   first, while these ask for at most one alignment an n-gram and one in
   ``SPARE`` words of the documents: edited copies of short items keep few
   n-grams.
3. The passage around the seeds of an item is aligned with the item by
   Smith-Waterman over words (match 2, mismatch -1, gap -1), which scores copies
   with replaced, dropped and added words.  Many alignments of similar size run
   at once in numpy.

Only the benchmark's n-grams travel to the executors.  A benchmark of more than
``BLOCK_CHARS`` characters is cut into blocks of about that size, and the
documents are scanned once for each block; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches

N, WINDOW, SPARE = 3, 4, 500
MATCH, MISMATCH, GAP = 2, 1, 1
LEVEL, LEAST_RAW, SURE, LONG_RAW = 0.5, 12, 0.9, 200
BLOCK_CHARS = 8 << 20
CELLS = 1 << 22
SLOTS, LONG_WORD, WORDS_AT_ONCE = 1 << 20, 256, 1 << 16
BROADCAST_ROWS = 500_000
_STRIP = re.compile(r"^\W+|\W+$")
_EDGES = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_"))
SCHEMA = "doc_id long, item_id long, score double, raw int, seeds int, word_start int, word_end int"
FOUND = SCHEMA + ", text_hash long"
PASSAGES = "doc_id long, text_hash long, words binary, origin binary, grams array<int>, places binary"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII, as UTF-8.
_WIDE_SPACE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_LEADS = np.zeros(256, bool)
_LEADS[[s[0] for s in _WIDE_SPACE]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.random.default_rng(17).integers(0, 2**63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def bare(word: str) -> str:
    w = word.lower().strip(_EDGES)
    return w if w.isalnum() else _STRIP.sub("", w)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


class Seeds:
    """One block of the benchmark: items as word ids, their n-grams, and which of those are seeds."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.names = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.base = np.uint64(len(self.vocab) + 1)
        self.items = [np.array([self.vocab[w] for w in words], np.int32) for _, words in items]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.sizes = sorted({min(N, len(x)) for x in self.items if len(x)})
        own = [(k, self.keys_of(x, min(N, len(x)))) for k, x in enumerate(self.items) if len(x)]
        flat = np.concatenate([g for _, g in own]) if own else np.empty(0, np.uint64)
        item = np.repeat([k for k, _ in own], [len(g) for _, g in own]).astype(np.int64)
        off = np.concatenate([np.arange(len(g)) for _, g in own]) if own else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.off = item[order], off[order]
        # How far from an n-gram an alignment of one of its items could reach.
        pad = 2 + self.lengths[self.item] // 2
        if len(flat):
            self.before = np.maximum.reduceat(self.off + pad, self.first)
            self.after = np.maximum.reduceat(self.lengths[self.item] - self.off + pad, self.first)
        self.chosen = np.ones(len(self.keys), bool)

    def keys_of(self, ids: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Keys of the n-grams of word ids, at all places or those given; keys of different lengths differ, as ids start from 1."""
        at = np.arange(max(0, len(ids) - n + 1)) if at is None else at
        key = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = key * self.base + ids[at + k].astype(np.uint64)
        return key

    def hits(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the block's n-grams in texts that end at ``bounds``, ascending, and which n-grams they are."""
        known, ats, grams = ids > 0, [], []
        for n in self.sizes:
            if len(ids) < n:
                continue
            run = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                run &= known[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(run)
            at = at[at + n <= bounds[np.searchsorted(bounds, at, "right")]]
            key = self.keys_of(ids, n, at)
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            own = self.keys[place] == key
            ats.append(at[own])
            grams.append(place[own])
        if not ats:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, gram = np.concatenate(ats), np.concatenate(grams)
        order = np.argsort(at, kind="stable")
        return at[order], gram[order]

    def choose(self, counts: np.ndarray, words: int) -> None:
        """Marks seeds, given how often each n-gram occurs and of how many words the documents are; ties: the earlier key."""
        keep = np.zeros(len(self.keys), bool)
        order = np.lexsort((self.keys, counts))
        rank = np.empty(len(self.keys), np.int64)
        rank[order] = np.arange(len(self.keys))
        for x in self.items:
            if len(x):
                at = np.searchsorted(self.keys, self.keys_of(x, min(N, len(x))))
                r = rank[at]
                if len(r) > WINDOW:
                    low = np.lib.stride_tricks.sliding_window_view(r, WINDOW).argmin(axis=1) + np.arange(len(r) - WINDOW + 1)
                    keep[at[np.unique(low)]] = True
                else:
                    keep[at[r.argmin()]] = True
        work = np.cumsum(np.where(keep, 0, counts * self.many)[order])
        keep[order[work <= len(self.keys) + words // SPARE]] = True
        self.chosen = keep


class Reader:
    """Turns a column of texts into ids of benchmark words; other words are 0, and bare punctuation is left out.

    Words are told apart by 64 bits of hash over their bytes, so only a word
    that is not among the last ``SLOTS`` met becomes a Python string.
    """

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self.key, self.value = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)

    def _id(self, word: bytes) -> int:
        w = bare(word.decode("utf-8", "replace"))
        return self.vocab.get(w, 0) if w else -1

    def _hashes(self, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of words of at most ``LONG_WORD`` bytes; ``view`` holds the eight bytes from each place on."""
        with np.errstate(over="ignore"):
            h = size.astype(np.uint64) * _ODD[0]
            own, at = np.arange(len(start)), 0
            while len(own):
                left = size[own] - at
                x = view[start[own] + at] & _MASKS[np.minimum(left, 8)]
                x = (h[own] ^ x) * _ODD[1]
                x ^= x >> np.uint64(31)
                h[own] = x * _ODD[2]
                own, at = own[left > 8], at + 8
            h ^= h >> np.uint64(29)
            h[h == 0] = 1
        return h

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends; a null text counts as empty."""
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        if not n or offsets[-1] == offsets[0]:
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        raw = bytes(memoryview(data)[int(offsets[0]) : int(offsets[-1])]) + b"\0" * 8
        offsets = offsets - offsets[0]
        buf = np.frombuffer(raw, np.uint8)[:-8]
        space = _SPACE[buf]
        for at in np.flatnonzero(_LEADS[buf]).tolist():
            for s in _WIDE_SPACE:
                if raw.startswith(s, at):
                    space[at : at + len(s)] = True
        edge = np.empty(len(buf), bool)
        edge[0], edge[1:] = True, space[:-1]
        edge[offsets[:-1][offsets[:-1] < len(buf)]] = True
        start = np.flatnonzero(edge & ~space)
        edge[-1], edge[:-1] = True, space[1:]
        edge[offsets[1:][offsets[1:] > 0] - 1] = True
        size = np.flatnonzero(edge & ~space) + 1 - start
        view = np.ndarray((len(buf),), "<u8", raw, strides=(1,))
        ids = np.empty(len(start), np.int32)
        for at in range(0, len(start), WORDS_AT_ONCE):
            own = slice(at, at + WORDS_AT_ONCE)
            ids[own] = self._ids(raw, view, start[own], size[own])
        ends = np.searchsorted(start, offsets[1:])
        if (ids < 0).any():
            keep = ids >= 0
            ends = np.r_[0, np.cumsum(keep)][ends]
            ids = ids[keep]
        return ids, ends

    def _ids(self, raw: bytes, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ids = np.empty(len(start), np.int32)
        short = np.flatnonzero(size <= LONG_WORD)
        if len(short) < len(start):
            for k in np.flatnonzero(size > LONG_WORD).tolist():
                ids[k] = self._id(raw[start[k] : start[k] + size[k]])
            start, size = start[short], size[short]
        h = self._hashes(view, start, size)
        slot = (h >> np.uint64(44)).astype(np.int64)
        got = self.value[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            own, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            found = np.array([self._id(raw[a : a + b]) for a, b in zip(start[at].tolist(), size[at].tolist())], np.int32)
            got[new] = found[back]
            place = (own >> np.uint64(44)).astype(np.int64)
            self.key[place], self.value[place] = own, found
        ids[short] = got
        return ids


def align(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of many pairs; items (n, m) padded with -1, windows (n, w) padded with -2."""
    n, w = windows.shape
    row = np.zeros((n, w + 1), np.int32)
    best = np.zeros(n, np.int32)
    slope = (np.arange(w + 1) * GAP).astype(np.int32)
    for j in range(items.shape[1]):
        same = windows == items[:, j : j + 1]
        new = np.zeros_like(row)
        new[:, 1:] = row[:, :-1] + np.where(same, MATCH, -MISMATCH).astype(np.int32)
        np.maximum(new, row - GAP, out=new)
        np.maximum(new, 0, out=new)
        # A gap along the window: the best of all cells to the left, less GAP a step.
        np.maximum(new, np.maximum.accumulate(new + slope, axis=1) - slope, out=new)
        pad = items[:, j] < 0
        new[pad] = row[pad]
        row = new
        np.maximum(best, row.max(axis=1), out=best)
    return best


def passages(seeds: Seeds, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, words, origin, n-grams, their places) of each text that holds an n-gram.

    ``words`` are the stretches around n-grams, one after another, ``origin``
    says where in the text each word stands, and places count in ``words``.
    """
    at, gram = seeds.hits(ids, ends)
    if not len(at):
        return
    doc = np.searchsorted(ends, at, "right")
    begin = np.r_[0, ends[:-1]]
    low = np.maximum(at - seeds.before[gram], begin[doc])
    high = np.maximum.accumulate(np.minimum(at + seeds.after[gram], ends[doc]))
    low = np.minimum.accumulate(low[::-1])[::-1]
    new = np.r_[True, low[1:] >= high[:-1]]
    first = np.flatnonzero(new)
    low, high = low[first], high[np.r_[first[1:] - 1, len(at) - 1]]
    size = high - low
    shift = low - (np.cumsum(size) - size)
    place = np.repeat(shift, size) + np.arange(int(size.sum()))  # of each kept word
    moved = at - shift[np.cumsum(new) - 1]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(doc)].tolist()):
        d = int(doc[a])
        lo, hi = np.searchsorted(place, [begin[d], ends[d]])
        yield d, ids[place[lo:hi]], (place[lo:hi] - begin[d]).astype(np.int32), gram[a:b].astype(np.int32), (moved[a:b] - lo).astype(np.int32)


def find(seeds: Seeds, rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, float, int, int, int, int]]:
    """(row, item, score, raw, seeds, start, end) of each leak, from (words, origin, n-grams, places): the best passage of each row and item."""
    todo = []
    for d, (ids, origin, gram, at) in enumerate(rows):
        own = seeds.chosen[gram]
        gram, at = gram[own], at[own]
        if not len(gram):
            continue
        many = seeds.many[gram]
        place = np.repeat(seeds.first[gram] + many - np.cumsum(many), many) + np.arange(int(many.sum()))
        item, begin = seeds.item[place], np.repeat(at, many) - seeds.off[place]
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        size = seeds.lengths[item]
        # Hits of one item whose passages overlap are one passage.
        new = np.r_[True, (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + size[1:])]
        hits = np.bincount(np.cumsum(new) - 1)
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(begin) - 1]
        pad = 2 + size[first] // 2
        low = np.maximum(0, begin[first] - pad)
        high = np.minimum(len(ids), begin[last] + size[first] + pad)
        for k, a, b, h in zip(item[first].tolist(), low.tolist(), high.tolist(), hits.tolist()):
            todo.append((d, k, int(origin[a]), int(origin[b - 1]) + 1, h, ids[a:b]))
    todo.sort(key=lambda t: (len(t[5]), len(seeds.items[t[1]])))
    best: dict[tuple[int, int], tuple] = {}
    at = 0
    while at < len(todo):
        to, m = at, 1
        while to < len(todo):
            m = max(m, len(seeds.items[todo[to][1]]))
            if to > at and (to + 1 - at) * len(todo[to][5]) * 4 > CELLS:
                break
            to += 1
        own = todo[at:to]
        w = max(len(t[5]) for t in own)
        items, wins = np.full((len(own), m), -1, np.int32), np.full((len(own), w), -2, np.int32)
        for r, (_, k, _, _, _, win) in enumerate(own):
            items[r, : len(seeds.items[k])] = seeds.items[k]
            wins[r, : len(win)] = win
        for (d, k, a, b, hits, _), raw in zip(own, align(items, wins).tolist()):
            score = raw / (MATCH * len(seeds.items[k]))
            told = score >= LEVEL and raw >= LEAST_RAW or score >= SURE or raw >= LONG_RAW
            if told and ((d, k) not in best or best[d, k][3] < raw):
                best[d, k] = (d, k, score, raw, hits, a, b)
        at = to
    return sorted(best.values())


def _scanner(seeds: Seeds) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seeds.vocab)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("words", pa.binary()), ("origin", pa.binary()), ("grams", pa.list_(pa.int32())), ("places", pa.binary())]
        )
        total = 0
        for batch in batches:
            ids, ends = reader(batch.column("text"))
            total += len(ids)
            found = list(passages(seeds, ids, ends))
            own = pa.array([d for d, *_ in found], pa.int64())
            parts = [batch.column(c).take(own) for c in ("doc_id", "text_hash")]
            parts += [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (1, 2)]
            parts += [pa.array([x[3] for x in found], pa.list_(pa.int32())), pa.array([x[4].tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, schema=schema)
        # One more row without passages tells how many words the task has read.
        count = [pa.array([None], pa.int64()), pa.array([total], pa.int64()), *[pa.array([None], f.type) for f in list(schema)[2:]]]
        yield pa.RecordBatch.from_arrays(count, schema=schema)

    return run


def _aligner(seeds: Seeds) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for pdf in batches:
            ints = lambda c: [np.frombuffer(x, np.int32) for x in pdf[c]]
            found = find(seeds, zip(ints("words"), ints("origin"), [np.asarray(g, np.int64) for g in pdf["grams"]], ints("places")))
            ids, texts = pdf["doc_id"].astype("Int64"), pdf["text_hash"]
            out = [(ids.iloc[d], seeds.names[k], *rest, texts.iloc[d]) for d, k, *rest in found]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Seeds]:
    """The benchmark in blocks of about ``block_chars`` characters; rows that are equal count once."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    many = max(1, -(-chars // block_chars))
    for b in range(many):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).distinct().orderBy("item_id", "text").collect()
        found = Seeds([(r.item_id, w) for r in own if (w := item_words(r.text))])
        if len(found.keys):
            yield found


def _found(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> DataFrame:
    """Leaks with the hash of their text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    out = []
    for seeds in blocks(benchmark, block_chars):
        kept = materialize(rows.mapInArrow(_scanner(seeds), PASSAGES), "leak-passages")
        words = kept.where("grams is null").agg(F.sum("text_hash").alias("n")).first()["n"] or 0
        kept = kept.where("grams is not null")
        counts = np.zeros(len(seeds.keys), np.int64)
        # At most one row for each n-gram of the block.
        for r in kept.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r.gram] = r.n
        seeds.choose(counts, words)
        out.append(kept.mapInPandas(_aligner(seeds), FOUND))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each pair of document and item that holds a seed and aligns well.

    That is a score of ``LEVEL`` of a full match or more with a raw score of
    ``LEAST_RAW`` (items of up to five words need ``SURE`` instead), or a raw
    score of ``LONG_RAW``, a long quote of a still longer item.  Returns doc_id,
    item_id, score (0 to 1), the raw score, the number of seeds and the range of
    words aligned.  Null and empty texts on either side match nothing; a
    repeated row of documents is reported again, a repeated row of the benchmark
    is not, and different texts of one item_id are items of their own; without a
    benchmark there are no rows.
    """
    return _found(docs, benchmark, block_chars).drop("text_hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = _found(docs, benchmark, block_chars).select(F.col("doc_id").alias("_leak_doc"), F.col("text_hash").alias("_leak_text")).distinct()
    bad = materialize(bad, "leak-rows")
    small = bad.count() <= BROADCAST_ROWS
    same = F.xxhash64(F.col("text").cast("string")) == F.col("_leak_text")
    return docs.join(F.broadcast(bad) if small else bad, same & F.col("doc_id").cast("long").eqNullSafe(F.col("_leak_doc")), "left_anti")
