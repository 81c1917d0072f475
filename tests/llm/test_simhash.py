"""op6 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from rasterloom.llm import components, simhash
from rasterloom.llm.queries import op6_simhash_groups

from .conftest import ODD


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    """{key: fingerprint} to {key: set of keys reachable}."""
    keys = sorted(prints)
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints(odd):
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in simhash.simhash(odd).collect())
    assert got == sorted((str(d), brute_fingerprint(t)) for d, t in ODD)


@pytest.mark.parametrize("shard_rows", [4, 4096])
def test_links_equal_all_pairs(spark, shard_rows):
    """Chains, dense balls and far points; small shards make every chunk pair meet."""
    rng = random.Random(4)
    points = []
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(9):
            points.append(p)
            for _ in range(rng.choice([1, 2, 3, 4])):
                p ^= 1 << rng.randrange(64)
    points += [0, 1, 3, (1 << 64) - 1]
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), shard_rows=shard_rows)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = brute_groups(dict(zip(signed, points)))
    assert {s: found.get(s, s) for s in signed} == want


def plain_classes(shard, fp, meet, radius, sets=None, level=0.8):
    """Classes by comparing all pairs of a shard that ``meet``."""
    label = list(range(len(fp)))
    for a in range(len(fp)):
        for b in range(a):
            bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(fp[a], fp[b]))
            near = shard[a] == shard[b] and meet(a, b) and bits <= radius
            if near and (sets is None or len(set(sets[a]) & set(sets[b])) >= level * len(set(sets[a]) | set(sets[b]))):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return [label.index(x) for x in label]


@pytest.mark.parametrize("with_sets", [False, True])
def test_forest_equals_all_pairs(with_sets):
    rng = np.random.default_rng(8)
    for case in range(30):
        n = int(rng.integers(2, 70))
        centres = rng.integers(0, 2**63, (4, 2)).astype(np.uint64)
        fp = centres[rng.integers(0, 4, n)]
        for k in range(n):
            for bit in rng.integers(0, 128, rng.integers(0, 9)):
                fp[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        shard = np.sort(rng.integers(0, 3, n))
        role = np.full(n, 2) if case % 2 else rng.integers(0, 2, n)
        sets = [np.unique(rng.choice(12, rng.integers(8, 13))).astype(np.uint64) for _ in range(n)] if with_sets else None
        a, b = simhash.forest_edges(shard, fp, role, 6, sets)
        label = np.arange(n)
        label[a] = b
        got = [int(np.flatnonzero(label == x)[0]) for x in label]
        if case % 2:
            assert got == plain_classes(shard, fp, lambda a, b: True, 6, sets)
            continue
        # Queries must meet the tree; that members of the tree link here as well is free, as they meet elsewhere.
        least = plain_classes(shard, fp, lambda a, b: role[a] != role[b], 6, sets)
        most = plain_classes(shard, fp, lambda a, b: role[a] + role[b] < 2, 6, sets)
        assert all(got[k] == got[c] for k, c in enumerate(least)) and all(most[k] == most[c] for k, c in enumerate(got))


def test_dense_group_is_not_compared_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(9)
    fp = np.repeat(rng.integers(0, 2**63, (1, 32)).astype(np.uint64), 3000, axis=0)
    fp[np.arange(3000), rng.integers(0, 32, 3000)] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    pairs, distance = [], simhash.BKForest.distance
    monkeypatch.setattr(simhash.BKForest, "distance", lambda self, a, b: pairs.append(len(a)) or distance(self, a, b))
    moved, to = simhash.forest_edges(np.zeros(3000, np.int64), fp, np.full(3000, 2), 390)
    assert len(moved) == 2999 and set(to.tolist()) == {0}
    # Growing the tree takes a comparison for each member and node above it, its search none.
    assert sum(pairs) < 3000 * 3000 / 4


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7), (None, 3), (500, k := 200)]
    edges += [(900, 900 + k) for k in range(1, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_groups_of_odd_rows(odd):
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(odd).collect())
    prints = {k: brute_fingerprint(t) for k, (_, t) in enumerate(ODD)}
    label = brute_groups(prints)
    low = {}
    for k, (d, _) in enumerate(ODD):
        if d is not None:
            low[label[k]] = min(d, low.get(label[k], d))
    assert got == sorted((str(d), prints[k], low.get(label[k])) for k, (d, _) in enumerate(ODD))


def test_keep_one_of_odd_rows(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    label = brute_groups({k: brute_fingerprint(t) for k, (_, t) in enumerate(ODD)})
    assert len(rows) == len(set(label.values()))


def test_keep_one_of_one_id_on_two_texts(docs_of):
    """Different texts under one doc_id both remain, in whatever groups they are; equal rows fold."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (4, "another text that is like none of these at all"), (None, "nobody owns this one, and nothing is like it"), (None, c)]
    kept = simhash.keep_one(docs_of(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("4", c), ("4", docs[6][1]), ("None", docs[7][1])])


def test_hot_fingerprints(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    docs = [(k, "one text for all of them" if k % 3 else f"text number {k} of its own") for k in range(30)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(docs_of(docs)).collect())
    label = brute_groups({d: brute_fingerprint(t) for d, t in docs})
    assert got == sorted(label.items())


def test_empty(empty):
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    label = brute_groups(prints)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op6_simhash_groups(spark, sf_dir).collect())
    assert got == sorted((d, f"{p:016x}", label[d]) for d, p in prints.items())


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def families(seed=6, size=150, many=10):
    """Texts of ``size`` words and copies of each with ever more changed words."""
    rng = random.Random(seed)
    out = []
    for f in range(many):
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for c in (0, 1, 2, 3, 12, 25):
            own = list(words)
            for k in rng.sample(range(size), c):
                own[k] = f"x{rng.randrange(10**6)}"
            out.append((10 * f + min(c, 9) if c < 12 else 1000 + 10 * f + c, " ".join(own)))
    return out


def expected_classes(texts, level):
    label = {d: d for d, _ in texts}
    links = [(a, b) for k, (a, x) in enumerate(texts) for b, y in texts[:k] if similarity(x, y) >= level]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("shard_rows", [4, 4096])
def test_similar_texts_link(spark, docs_of, shard_rows):
    """All pairs of 0.8 or more are linked, and no linked class goes below 0.65."""
    texts = families()
    prints = simhash.simhash(docs_of(texts), wide=True).cache()
    fp = {r.doc_id: r.fp for r in prints.collect()}
    found = {r.node: r.component for r in components.connected_components(simhash.similar_links(prints, shard_rows=shard_rows)).collect()}
    got = {d: found.get(p, p) for d, p in fp.items()}
    high, low = expected_classes(texts, 0.8), expected_classes(texts, 0.65)
    for a, x in texts:
        for b, y in texts:
            if high[a] == high[b]:
                assert got[a] == got[b], (a, b, similarity(x, y))
            if got[a] == got[b]:
                assert low[a] == low[b], (a, b, similarity(x, y))


@pytest.mark.parametrize("shard_rows, broadcast", [(4, 10**6), (4096, 10**6), (4096, 0)])
def test_links_are_exact(spark, docs_of, monkeypatch, shard_rows, broadcast):
    """Pairs of every similarity from 0.6 to 0.95: exactly those of 0.8 or more are linked."""
    monkeypatch.setattr(simhash, "CANDIDATE_ROWS", broadcast)
    rng = random.Random(3)
    texts = []
    for k in range(240):
        words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 300 - 25 - k // 4] + [f"y{rng.randrange(10**6)}" for _ in range(k // 4)]))]
    scores = {k: similarity(texts[2 * k][1], texts[2 * k + 1][1]) for k in range(240)}
    assert sum(s >= 0.8 for s in scores.values()) > 60 and sum(0.7 < s < 0.8 for s in scores.values()) > 40
    prints = simhash.simhash(docs_of(texts), wide=True).cache()
    fp = {r.doc_id: r.fp for r in prints.collect()}
    found = {r.node: r.component for r in components.connected_components(simhash.similar_links(prints, shard_rows=shard_rows)).collect()}
    got = {d: found.get(p, p) for d, p in fp.items()}
    assert {k for k in scores if got[2 * k] == got[2 * k + 1]} == {k for k, s in scores.items() if s >= 0.8}


def test_keep_one_of_similar_texts(docs_of):
    texts = families(8)
    kept = {r.doc_id for r in simhash.keep_one(docs_of(texts)).collect()}
    assert len(kept) == len({*expected_classes(texts, 0.8).values()})


def test_wide_bits_of_short_and_empty_texts():
    printer = simhash.WidePrinter()
    assert printer(None) == printer("") == printer(" \n") == (bytes(256), [])
    one = [printer(t) for t in ("a", "A ", "a b", "a b c d e", "a b c d e f")]
    assert one[0] == one[1] and len({w for w, _ in one}) == 4 and all(len(b) == 8 for _, b in one)
    again = simhash.WidePrinter()
    assert [again("word " * 20_000 + str(k)) for k in range(2)] == [printer("word " * 20_000 + str(k)) for k in range(2)]
