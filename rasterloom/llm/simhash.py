"""SimHash fingerprints, BK-tree linking and near-duplicate groups.

Fingerprints are cut into five blocks (13, 13, 13, 13 and 12 bits).  Two that
differ in at most three bits agree on two whole blocks at least, so each
fingerprint goes to ten shards, one for each pair of blocks.  A shard gets a
BK-tree: children hang on edges labelled with the Hamming distance to their
parent, and a query follows only edges whose label lies within the radius of
its own distance.  Trees of all shards of a batch are built and searched level
by level in numpy, and each shard answers with a spanning forest, never with
all pairs.  A shard of more than ``SHARD_ROWS`` members is cut into chunks; a
task holds the tree of one chunk and the queries of another, so a group that
holds a third of all rows is spread over many tasks and loses no link.

At a radius of 3 in 64 bits only texts with a handful of changes link.  Near
copies by similarity (``level``) are found with a wide SimHash of ``WIDE_BITS``
bits over the set of five-word shingles: the share of differing bits tells the
angle between two sets, hence their Jaccard similarity.  Its shards are keyed by
``LINK_BANDS`` pairs of minima over the shingles' hashes, which two texts of that
similarity share in at least one band but for 8 in 100 million cases; the same
trees are built and searched there, with ``SLACK`` standard deviations to spare
(3 in 10 million).  What they find are candidates only.  Texts that candidates
connect meet once more with their shingles, and a pair becomes a link if the
exact Jaccard similarity of the two sets of 64-bit shingle hashes is
``level`` or more, and is left unchecked only where links join the two already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import batch_rows, materialize, small_batches

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SHARD_ROWS = 4096
BATCH_ROWS = 65_536
FRONTIER = 1 << 20
SPREAD = 8
HOT_ROWS, BROADCAST_ROWS = 10_000, 100_000
CANDIDATE_ROWS = 1_000_000  # of two longs each: some 40 MB where they are broadcast
SHINGLE, LEVEL = 5, 0.8
WIDE_WORDS, BANDS, LINK_BANDS, SLACK = 32, 8, 16, 5.0
BATCH_BYTES = 64 << 20
WIDE_BITS = 64 * WIDE_WORDS
MOST_WORDS = 300_000
_RNG = np.random.default_rng(13)
SALTS, ODDS = (_RNG.integers(0, 2**63, WIDE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
POWERS = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``, as an unsigned int; 0 if there is no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        h = np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def wide_radius(level: float) -> int:
    """The differing wide bits that texts of that similarity are expected to have, plus ``SLACK`` standard deviations."""
    share = np.arccos(2 * level / (1 + level)) / np.pi
    return int(WIDE_BITS * (share + SLACK * np.sqrt(share * (1 - share) / WIDE_BITS)))


class WidePrinter:
    """Wide SimHash and band keys of texts; hashes of words met before are kept, up to a bound."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def _shingles(self, text: str | None) -> np.ndarray:
        """Distinct hashes of the word shingles (of the whole sequence, if it is shorter)."""
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            for k, g in enumerate(got):
                if g is None:
                    got[k] = self.known[words[k]] = xxhash.xxh64_intdigest(words[k])
        h = np.array(got, np.uint64)
        if len(h) < self.width:
            own = xxhash.xxh64_intdigest(b" ".join(words), 7) if words else None
            return np.array([own], np.uint64) if words else np.empty(0, np.uint64)
        n = len(h) - self.width + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            out += h[k : k + n] * POWERS[k]
        out ^= out >> np.uint64(29)
        return np.unique(out)

    def __call__(self, text: str | None) -> tuple[bytes, list[int]]:
        return self.prints(text, BANDS)

    def prints(self, text: str | None, bands: int) -> tuple[bytes, list[int]]:
        """Wide SimHash and so many band keys."""
        h = self._shingles(text)
        total = np.zeros((8 * WIDE_WORDS, 8), np.int64)
        low = np.full(WIDE_WORDS, ~np.uint64(0))
        places = np.arange(8 * WIDE_WORDS) * 256
        for at in range(0, len(h), 8192):
            mixed = (h[at : at + 8192, None] ^ SALTS) * ODDS
            mixed ^= mixed >> np.uint64(31)
            mixed *= ODDS[::-1]
            mixed ^= mixed >> np.uint64(29)
            low = np.minimum(low, mixed.min(axis=0))
            seen = np.bincount((mixed.view(np.uint8) + places).ravel(), minlength=256 * len(places))
            total += seen.reshape(-1, 256) @ _BYTE_BITS
        bits = np.packbits(2 * total > len(h), axis=1, bitorder="little")
        keys = (low[: 2 * bands : 2] * POWERS[0] + low[1 : 2 * bands : 2] * POWERS[1]) ^ np.arange(bands, dtype=np.uint64)
        return bits.tobytes(), keys.view(np.int64).tolist() if len(h) else []


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp, "text_key": pdf["text_key"]})


def _wide_fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    printer = WidePrinter()
    for pdf, out in ((p, next(_fingerprints(iter([p])))) for p in batches):
        both = [printer.prints(t, LINK_BANDS) for t in pdf["text"]]
        yield out.assign(wide=[w for w, _ in both], bands=[b for _, b in both], text=pdf["text"])


def _with_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    printer = WidePrinter()
    for pdf in batches:
        yield pdf[["shard", "fp", "wide"]].assign(grams=[printer._shingles(t).tobytes() for t in pdf["text"]])


def simhash(docs: DataFrame, wide: bool = False) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fp, text_key)``: one row per input row, ``fp`` the fingerprint's bits as a signed long.

    A null text counts as empty, and an empty text or one without words has
    fingerprint zero.  A null doc_id stays null.  ``wide`` adds the wide SimHash,
    its band keys (none for a text without words) and the text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key().alias("text_key"))
    if wide:
        return rows.mapInPandas(_wide_fingerprints, "doc_id long, fp long, text_key long, wide binary, bands array<long>, text string")
    return rows.mapInPandas(_fingerprints, "doc_id long, fp long, text_key long")


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


class Classes:
    """Disjoint sets of 0 to n - 1, each named by its smallest member.

    With ``sets``, only pairs whose sets have a similarity of ``level`` or more join.
    """

    def __init__(self, n: int, sets: list[np.ndarray] | None = None, level: float = LEVEL):
        self.labels, self.sets, self.level = np.arange(n), sets, level
        self.sizes = None if sets is None else np.fromiter(map(len, sets), np.int64, n)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.labels[a] == self.labels[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merges the classes of each pair; with ``sets``, a pair within one class needs no look."""
        if self.sets is not None:
            a, b = self._similar(a, b)
        labels = self.labels
        while True:
            la, lb = labels[a], labels[b]
            if (la == lb).all():
                self.labels = labels
                return
            low = np.minimum(la, lb)
            np.minimum.at(labels, la, low)
            np.minimum.at(labels, lb, low)
            while (labels[labels] != labels).any():
                labels = labels[labels]

    def _similar(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are similar enough and not joined by earlier ones."""
        fits = np.minimum(self.sizes[a], self.sizes[b]) >= self.level * np.maximum(self.sizes[a], self.sizes[b]) - 1e-9
        fits &= ~self.same(a, b)
        a, b = a[fits], b[fits]
        la, lb = self.labels[a].tolist(), self.labels[b].tolist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        joins = []
        for k, (x, y, rx, ry) in enumerate(zip(a.tolist(), b.tolist(), la, lb)):
            rx, ry = root(rx), root(ry)
            if rx != ry and jaccard(self.sets[x], self.sets[y]) >= self.level:
                parent[max(rx, ry)] = min(rx, ry)
                joins.append(k)
        return a[joins], b[joins]


class BKForest:
    """One BK-tree for each shard, all grown at once: level by level, without a Python loop over nodes.

    fp: (n, words) of unsigned 64-bit words.  Growing a tree compares each member
    with all nodes above it; ``classes`` is told which of them lie within ``radius``.
    A subtree whose members are of one class is ``whole`` from then on.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray, members: np.ndarray, radius: int = RADIUS, classes: Classes | None = None):
        self.fp, n = fp, len(fp)
        self.bits = 64 * fp.shape[1]
        self.frontier = FRONTIER // fp.shape[1]
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        parents, edges, nodes = [], [], []
        rest, group = members, shard[members]
        first = True
        while len(rest):
            order = np.argsort(group, kind="stable")
            rest, group = rest[order], group[order]
            head = np.r_[True, group[1:] != group[:-1]]
            node = rest[head]
            if first:
                self.root[group[head]] = node
                first = False
            else:
                parents.append(owner[order][head])
                edges.append(label[order][head])
                nodes.append(node)
            own = node[np.cumsum(head) - 1]
            keep = ~head
            rest, owner = rest[keep], own[keep]
            label = self.distance(rest, owner)
            if classes is not None:
                near = label <= radius
                classes.join(rest[near], owner[near])
            group = owner * (self.bits + 1) + label
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        key = cat(parents) * (self.bits + 1) + cat(edges)
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], cat(nodes)[order]
        self.radius, self.classes = radius, classes
        if classes is not None:
            self.whole = np.ones(n, bool)
            for up, down in zip(parents[::-1], nodes[::-1]):
                self.whole[up[~self.whole[down] | ~classes.same(up, down)]] = False

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), self.frontier):
            own = slice(at, at + self.frontier)
            out[own] = np.bitwise_count(self.fp[a[own]] ^ self.fp[b[own]]).sum(axis=1)
        return out

    def search(self, query: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields blocks of (query, member) index pairs within the radius.

        With ``classes``, subtrees that are wholly of the query's own class are
        passed over: nothing in them can join two classes.
        """
        radius = self.radius
        start = self.root[shard]
        stack = [(query[start >= 0], start[start >= 0])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
                continue
            if self.classes is not None:
                open_ = ~(self.whole[node] & self.classes.same(q, node))
                q, node = q[open_], node[open_]
            d = self.distance(q, node)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.key, node * (self.bits + 1) + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * (self.bits + 1) + np.minimum(d + radius, self.bits), "right")
            many = hi - lo
            total = int(many.sum())
            if total:
                at = np.repeat(hi - np.cumsum(many), many) + np.arange(total)
                stack.append((np.repeat(q, many), self.child[at]))


def forest_edges(shard: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int = RADIUS, sets: list[np.ndarray] | None = None, level: float = LEVEL):
    """Edges of a spanning forest of all links; role: 0 tree only, 1 query only, 2 both.

    With ``sets``, only pairs whose sets have that similarity are links.
    """
    classes = Classes(len(fp), sets, level)
    trees = BKForest(shard, fp, np.flatnonzero(role != 1), radius, classes)
    ask = np.flatnonzero(role != 0)
    for at in range(0, len(ask), 8192):
        own = ask[at : at + 8192]
        for q, node in trees.search(own, shard[own]):
            classes.join(q, node)
    moved = np.flatnonzero(classes.labels != np.arange(len(fp)))
    return moved, classes.labels[moved]


def _link(radius: int, level: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[["shard", "i", "j"]].to_numpy(np.int64)
            new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
            shard = np.cumsum(new) - 1
            alone = np.bincount(shard) == 1
            pdf, shard = pdf[~alone[shard]], shard[~alone[shard]]
            fp = pdf["fp"].to_numpy(np.int64)
            if not len(fp):
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            if "wide" in pdf:
                words = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(fp), -1)
                sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]] if "grams" in pdf else None
            else:
                words, sets = fp.view(np.uint64)[:, None], None
            a, b = forest_edges(shard, words, pdf["role"].to_numpy(np.int64), radius, sets, level)
            return pd.DataFrame({"a": fp[a], "b": fp[b]})

        held, size, load = [], 0, 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            load += int(pdf["grams"].map(len).sum()) if "grams" in pdf else 0
            if size < BATCH_ROWS and load < BATCH_BYTES:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = pdf.iloc[-1]
            open_ = (pdf["shard"] == last["shard"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])
            held, size, load = [pdf[open_]], int(open_.sum()), 0
            yield solve(pdf[~open_])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _shards(fps: DataFrame) -> DataFrame:
    """One row for each fingerprint and pair of blocks: ``(shard, fp)``."""
    pick = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    keys = [
        F.shiftleft(pick(a), 32) + F.shiftleft(pick(b), 8) + F.lit(t)
        for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("shard"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints ``(fp: long)`` to edges ``(a, b)`` that connect all that differ in ``radius`` bits or fewer."""
    if radius > 3:
        raise ValueError("five blocks prove two equal ones for a radius up to 3")
    return _linked(_shards(fps), radius, shard_rows)


def similar_links(prints: DataFrame, level: float = LEVEL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``simhash(wide=True)`` to edges ``(a, b)`` between fingerprints of texts of that similarity or more.

    Only rows of shards with company travel with their wide bits, and only texts
    with a candidate with their shingle hashes, once for each chunk they meet.
    """
    small_batches(prints.sparkSession)
    texts = materialize(prints.select("fp", "text_key", "wide", "bands").dropDuplicates(["fp", "text_key"]), "simhash-wide")
    rows = texts.select("fp", "text_key", F.explode("bands").alias("shard"))
    shared = materialize(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shard"), "simhash-shared")
    rows = rows.join(shared, "shard").join(texts.select("fp", "text_key", "wide"), ["fp", "text_key"]).drop("text_key")
    candidates = _linked(rows, wide_radius(level), shard_rows)
    groups = connected_components(candidates).select(F.col("node").alias("fp"), F.col("component").alias("shard"))
    groups = materialize(groups, "simhash-candidates")
    bodies = prints.select("fp", "text_key", "wide", "text")
    if groups.count() <= CANDIDATE_ROWS:
        # Texts without a candidate stay where they are; copies fold in their partitions before they travel.
        bodies = bodies.join(F.broadcast(groups), "fp").dropDuplicates(["fp", "text_key"])
    else:
        # Each different text travels once: it folds by the keys that it then joins by, so no fingerprint is hot.
        named = texts.select("fp", "text_key").join(groups, "fp")
        bodies = bodies.dropDuplicates(["fp", "text_key"]).join(named, ["fp", "text_key"])
    small_batches(prints.sparkSession)
    bodies = bodies.select("shard", "fp", "wide", "text")
    grams = materialize(bodies.mapInPandas(_with_shingles, "shard long, fp long, wide binary, grams binary"), "simhash-grams")
    return _linked(grams, wide_radius(level), shard_rows, level)


def _linked(rows: DataFrame, radius: int, shard_rows: int, level: float = LEVEL) -> DataFrame:
    """``(shard, fp)``, and ``wide`` and ``grams`` where those are to be compared, to edges between values of ``fp``."""
    spark = rows.sparkSession
    large = materialize(
        rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows), "simhash-large"
    )
    chunks = F.coalesce(F.ceil(F.col("n") / F.lit(float(shard_rows // 2))), F.lit(1)).cast("int")
    rows = rows.join(large, "shard", "left").withColumn("parts", chunks)
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    # Chunk c meets every chunk: as the tree of the pairs (c, j), as the queries of the pairs (i, c).
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(
            F.least(o, F.col("c")).cast("int").alias("i"),
            F.greatest(o, F.col("c")).cast("int").alias("j"),
            F.when(o == F.col("c"), 2).when(o > F.col("c"), 0).otherwise(1).alias("role"),
        ),
    )
    wide = [c for c in rows.columns if c in ("wide", "grams")]
    spread = rows.select("shard", "fp", *wide, F.explode(pairs).alias("p")).select("shard", "p.i", "p.j", "fp", "p.role", *wide)
    dealt = spread.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp")
    with batch_rows(spark, 2000 if "grams" in wide else 20_000):
        return materialize(dealt.mapInPandas(_link(radius, level), "a long, b long").where("a <> b").distinct(), "simhash-edges")


def _classes(prints: DataFrame, radius: int, level: float | None = None) -> DataFrame:
    """``(doc_id, fp, text_key)`` to one row per fingerprint: fp, n (rows), component, component_id and ``low``,
    which names the row of that fingerprint with the smallest doc_id."""
    low = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id"), F.col("text_key"))).alias("low")
    fps = materialize(prints.groupBy("fp").agg(low, F.count(F.lit(1)).alias("n")), "simhash-fps")
    edges = fingerprint_links(fps.select("fp"), radius)
    if level is not None:
        edges = edges.unionAll(similar_links(prints, level))
    groups = connected_components(edges).withColumnRenamed("node", "fp")
    named = fps.join(groups, "fp", "left").withColumn("linked", F.col("component").isNotNull())
    named = named.withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(SPREAD)).cast("int")), "simhash-named")
    # The members of a hot component meet its smallest id in SPREAD tasks; a fingerprint without links is its own component.
    lowest = named.where("linked").groupBy("component").agg(F.min("low.doc_id").alias("component_id"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = named.where("linked").join(lowest, ["component", "salt"]).select("fp", "n", "component", "component_id", "low")
    alone = named.where("not linked").select("fp", "n", "component", F.col("low.doc_id").alias("component_id"), "low")
    return materialize(met.unionAll(alone), "simhash-ids")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fp, component_id)``, one row per input row.

    Texts whose fingerprints differ in at most ``radius`` bits are linked, and
    ``component_id`` is the smallest doc_id that links reach.  Equal texts share
    a fingerprint; repeated rows are all returned; an empty table gives none.
    A component whose doc_ids are all null has a null id.
    """
    prints = materialize(simhash(docs), "simhash-docs")
    ids = _classes(prints, radius)
    hot = ids.where(F.col("n") > HOT_ROWS).select("fp", "component_id")
    rows, rest, out = prints.select("doc_id", "fp"), ids.select("fp", "component_id"), ["doc_id", "fp", "component_id"]
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return rows.join(rest, "fp").select(out)
    # Rows of hot fingerprints find their id without a shuffle.
    cold = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp")
    return rows.join(F.broadcast(hot), "fp").select(out).unionAll(cold.select(out))


def keep_one(docs: DataFrame, radius: int = RADIUS, level: float | None = LEVEL) -> DataFrame:
    """Rows of ``docs`` with one document for each group of near copies, the one with the smallest doc_id.

    Links are those of ``near_groups`` and those of five-word shingle sets whose
    exact similarity is ``level`` or more (None: no such links).
    All columns stay.  Rows are told apart by doc_id and text: of different
    texts under one doc_id each speaks for its own group, and of rows equal in
    both one remains.  Rows without a doc_id remain only where no row of their
    group has one, one for each group.
    """
    prints = materialize(simhash(docs, wide=level is not None), "simhash-docs")
    ids = _classes(prints, radius, level)
    key = [F.col("low.doc_id").alias("_keep_doc"), F.col("low.text_key").alias("_keep_text")]
    keep = materialize(ids.groupBy("component").agg(F.min("low").alias("low")).select(key), "simhash-keep")
    times = prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = times.select(F.col("doc_id").alias("_again_doc"), F.col("text_key").alias("_again_text"))
    again = materialize(again, "simhash-again")
    rows = docs.withColumn("_text_key", _text_key())
    same = lambda d, t: (F.col("_text_key") == F.col(t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    out = rows.join(keep, same("_keep_doc", "_keep_text"), "left_semi")
    if again.isEmpty():
        return out.select(docs.columns)
    once = out.join(again, same("_again_doc", "_again_text"), "left_anti")
    more = out.join(again, same("_again_doc", "_again_text"), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return once.unionByName(more).select(docs.columns)
