"""op1: alignment against plain dynamic programming, seeds against all pairs, planted copies."""

import random
import re

import numpy as np
import pyarrow as pa

from rasterloom.llm import decontaminate as dc
from rasterloom.llm.queries import op1_benchmark_leaks

from .conftest import ODD


def plain_alignment(item, window):
    best, rows = 0, [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (dc.MATCH if a == b else -dc.MISMATCH), rows[i - 1][j] - dc.GAP, rows[i][j - 1] - dc.GAP)
            best = max(best, rows[i][j])
    return best


def test_alignment():
    rng = random.Random(3)
    pairs = [([rng.randrange(4) + 1 for _ in range(rng.randint(1, 9))], [rng.randrange(5) for _ in range(rng.randint(1, 15))]) for _ in range(200)]
    items, wins = np.full((200, 9), -1), np.full((200, 15), -2)
    for k, (a, b) in enumerate(pairs):
        items[k, : len(a)], wins[k, : len(b)] = a, b
    assert dc.align(items, wins).tolist() == [plain_alignment(a, b) for a, b in pairs]


WORDS = [f"w{k}" for k in range(400)]


def passages(n, size=20, seed=5):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, k=size))) for k in range(n)]


def edited(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = "changed"
        elif kind == 1:
            words.insert(k, "added")
        else:
            del words[k]
    return " ".join(words)


def benchmark_of(spark, items):
    return spark.createDataFrame([(i, t, "more") for i, t in items], "item_id bigint, text string, doc_id string")


def test_planted_copies(spark, docs_of):
    """Exact, edited, upper-case and punctuated copies in long texts are found; other texts are not."""
    rng = random.Random(9)
    items = passages(12)
    noise = lambda n: " ".join(rng.choices(WORDS, k=n))
    docs, want = [], set()
    for k, t in items:
        for c, copy in enumerate([t, edited(t, rng, 2), t.upper().replace(" ", ", "), edited(t, rng, 3)]):
            docs.append((100 * k + c, f"{noise(60)} {copy} {noise(300)}"))
            want.add((100 * k + c, k))
    docs += [(5000 + k, noise(500)) for k in range(40)]
    docs.append((9000, " ".join(t for _, t in items)))
    want |= {(9000, k) for k, _ in items}
    found = dc.leaks(docs_of(docs), benchmark_of(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    kept = dc.keep_clean(docs_of(docs), benchmark_of(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == [5000 + k for k in range(40)] and kept.columns == docs_of(docs).columns


def test_blocks_find_the_same(spark, docs_of):
    rng = random.Random(2)
    items = passages(9)
    docs = docs_of([(k, f"{' '.join(rng.choices(WORDS, k=30))} {edited(t, rng, 1)}") for k, t in items])
    cut = lambda n: sorted((r.doc_id, r.item_id, r.score, r.raw) for r in dc.leaks(docs, benchmark_of(spark, items), n).collect())
    assert cut(300) == cut(1 << 20) and len(cut(300)) == 9


def test_common_passages_are_found_too(spark, docs_of):
    """A passage in a third of all documents has no rare n-gram, and is found in each of them."""
    items = passages(3)
    docs = [(k, items[0][1] + " and more of it") for k in range(60)] + [(100 + k, t) for k, t in passages(120, 40, 77)]
    found = dc.leaks(docs_of(docs), benchmark_of(spark, items)).collect()
    assert sorted(r.doc_id for r in found if r.item_id == 0) == list(range(60))


def test_odd_rows(spark, odd):
    items = [(1, "negative id."), (2, None), (3, ""), (None, "one two three"), (4, "one two three"), (4, "one two three"), (5, "??")]
    found = sorted((str(r.doc_id), r.item_id) for r in dc.leaks(odd, benchmark_of(spark, items)).collect())
    assert set(found) == {("-3", 1), ("6", 4), ("9", 4)} and found.count(("6", 4)) >= 2
    assert dc.keep_clean(odd, benchmark_of(spark, items)).count() == len(ODD) - 4


def test_empty(spark, odd, empty):
    none = benchmark_of(spark, [])
    assert dc.leaks(odd, none).count() == 0 and dc.keep_clean(odd, none).count() == len(ODD)
    assert dc.leaks(empty, benchmark_of(spark, passages(3))).count() == 0 and dc.keep_clean(empty, benchmark_of(spark, passages(3))).count() == 0


def test_reader_reads_words():
    """Ids are those of Python's own words, whatever the white space, punctuation and length."""
    texts = [None, "", "w1 W2,w3\u00a0(w4)\u2003w5\u3000w6\x85w7\x1cw8", "...", "w1", "w" * 300 + " w9 " + "x" * 5000, "«w1» é w_1", " w2 - w3 ", "\ud7ffw1 w2\n"]
    vocab = {w: k + 1 for k, w in enumerate([f"w{k}" for k in range(10)] + ["w" * 300, "é"])}
    for cut in (texts, texts[3:], texts[:1]):
        for _ in range(2):
            ids, ends = dc.Reader(vocab)(pa.array(["skipped", *cut], pa.string())[1:])
            got = [x.tolist() for x in np.split(ids, ends)[:-1]]
            assert got == [[vocab.get(w, 0) for w in dc.item_words(t)] for t in cut]


def test_long_quotes_and_repeated_items(spark, docs_of):
    """A long quote of a still longer item counts; rows of the benchmark that are equal count once, others of one id each."""
    long = " ".join(f"q{k}" for k in range(400))
    items = [(1, long), (1, long), (1, passages(1)[0][1])]
    docs = [(10, " ".join(f"q{k}" for k in range(120))), (11, " ".join(f"q{k}" for k in range(60))), (12, passages(1)[0][1]), (13, long)]
    found = sorted((r.doc_id, r.item_id, r.raw) for r in dc.leaks(docs_of(docs), benchmark_of(spark, items)).collect())
    assert found == [(10, 1, 240), (12, 1, 40), (13, 1, 800)]


def test_edited_short_items(spark, docs_of):
    """Of 15-word items with a fifth of their words replaced, copies that align at LEVEL are found but for one in a hundred."""
    rng = random.Random(31)
    items, docs, want = passages(300, 15, 8), [], set()
    vocab = {w: k + 1 for k, w in enumerate(WORDS)}
    for k, t in items:
        copy = [w if rng.random() > 0.2 else "changed" for w in t.split()]
        docs.append((k, " ".join(["before"] * 30 + copy + ["after"] * 30)))
        if plain_alignment([vocab[w] for w in t.split()], [vocab.get(w, 0) for w in copy]) >= 15:
            want.add((k, k))
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(docs), benchmark_of(spark, items)).collect()}
    assert len(want) > 200 and len(want - found) <= len(want) // 100


def test_query_equals_all_pairs(spark, sf_dir):
    """Every pair whose whole texts align at LEVEL is reported, and every reported pair aligns.

    The texts are walked word by word against all items at once, apart from the library's own alignment.
    """
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: (r.text or "").split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = lambda words: [w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in words) if w]
    items = {i: w for i, x in items.items() if (w := plain(x))}
    found = {(r.doc_id, r.item_id): r for r in op1_benchmark_leaks(spark, sf_dir).collect()}
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for x in items.values() for w in x}))}
    table = np.full((len(items), max(map(len, items.values()))), -1)
    for k, x in enumerate(items.values()):
        table[k, : len(x)] = [vocab[w] for w in x]
    same = {c: np.where(table == c, dc.MATCH, -dc.MISMATCH) for c in range(len(vocab) + 1)}
    steps = np.arange(table.shape[1] + 1) * dc.GAP
    for d, text in docs.items():
        row, best = np.zeros((len(items), len(steps)), int), np.zeros(len(items), int)
        for c in (vocab.get(w, 0) for w in plain((text or "").split())):
            new = np.maximum(row - dc.GAP, 0)
            new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + same[c])
            row = np.maximum(new, np.maximum.accumulate(new + steps, axis=1) - steps)
            np.maximum(best, row.max(axis=1), out=best)
        for (i, x), r in zip(items.items(), best.tolist()):
            score = r / (dc.MATCH * len(x))
            if score >= dc.LEVEL and r >= dc.LEAST_RAW:
                assert (d, i) in found, (d, i, score)
            if (d, i) in found:
                assert found[d, i].raw <= r and found[d, i].raw >= dc.LEVEL * dc.MATCH * len(x)
