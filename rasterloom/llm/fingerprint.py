"""Canonical exact digests, with DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space to one
space, no white space at either end.  ICU does the first three on the JVM
through Spark's ``reflect`` function; for ASCII texts they amount to ``lower``.
A fingerprint is 128 bits of XXH64 under two seeds.  Where fingerprints are
equal, canonical bytes are compared before texts count as equal.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

BUCKET_ROWS = 500
MOST_BUCKETS = 16_384
BROADCAST_ROWS = 200_000
HOT_ROWS = 10_000
COPIES = 10_000
LARGEST = 2**63 - 1
_ICU = "com.ibm.icu"


def canonical(text: Column) -> Column:
    """The canonical form of a text column; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    compose = lambda c: F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), compose(t), F.lit(True))
    ascii_only = F.octet_length(t) == F.length(t)
    plain = F.when(ascii_only, F.lower(t)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: XXH64 of the canonical text under two seeds."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second"), canon)))


def _literal(values: list[int | None]) -> Column:
    """A constant array of longs, folded once from one string."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",")


def _longs(values: list[int | None]) -> Column:
    return F.transform(_literal(values), lambda s: F.when(s != "", s.cast("long")))


class Neighbours:
    """Deals rows (doc_id, text) to buckets of neighbours, so that each row meets the next one in one shuffle.

    Rows stand by descending doc_id, null last; rows of one doc_id by a hash of
    their text.  Quantiles of doc_id split them into buckets of some
    ``bucket_rows`` rows, more in tables that would need over ``MOST_BUCKETS``
    (a bucket's sort and window spill, so it need not fit in memory).  A doc_id,
    or the lack of one, with more rows than that has buckets of its own, split
    by ranges of the hash.  A bucket also gets a copy of the first row of the
    bucket that follows it, and the last bucket one of the first.  The driver
    holds a few numbers for each bucket, and those of each hot doc_id: there are
    at most ``MOST_BUCKETS`` of these too.
    """

    def __init__(self, docs: DataFrame, bucket_rows: int = BUCKET_ROWS):
        n = docs.count()
        rows_each = max(bucket_rows, -(-n // MOST_BUCKETS))
        many = max(1, n // rows_each)
        cuts: set[int] = set()
        if many > 1:
            shares = [k / many for k in range(1, many)]
            cuts.update(docs.agg(F.percentile_approx("doc_id", shares, 10 * many).alias("q")).first()["q"] or [])
        counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_each).collect()
        hot = {r["doc_id"]: -(-r["n"] // rows_each) for r in counts}
        for v in hot:
            cuts.update(() if v is None else (v, v + 1) if v < LARGEST else (v,))
        self.cuts = sorted(cuts)
        self.step = max(1, int(len(cuts) ** 0.5))
        self.tops = self.cuts[:: self.step]
        # By range of doc_id, null first: how many buckets it has, and how many stand before them.
        self.parts = [hot.get(None, 1)] + [1] * (len(cuts) + 1)
        for v in hot:
            if v is not None:
                self.parts[bisect_right(self.cuts, v) + 1] = hot[v]
        self.hot = bool(hot)
        self.offsets = [0] * len(self.parts)
        total = 0
        for k in [*range(len(self.parts) - 1, 0, -1), 0]:
            self.offsets[k] = total
            total += self.parts[k]
        self.size = total
        heads = docs.select(self.bucket().alias("b"), "doc_id", F.bitwise_not(self._mark()).alias("m"))
        heads = heads.groupBy("b").agg(F.max(F.struct("doc_id", "m")).alias("top")).collect()
        self.first = {r["b"]: (r["top"]["doc_id"], ~r["top"]["m"]) for r in heads}
        order = sorted(self.first)
        self.before = {b: order[k - 1] for k, b in enumerate(order)}  # the bucket whose last row is followed by b's first

    def _range(self) -> Column:
        """1 for a null doc_id, else 2 more than the number of cuts at or below it; a search in two levels."""
        if not self.cuts:
            return F.when(F.col("doc_id").isNull(), 1).otherwise(2)
        top = F.size(F.filter(_longs(self.tops), lambda t: t <= F.col("doc_id")))
        below = F.slice(_longs(self.cuts), (top - 1) * self.step + 1, F.lit(self.step))
        fine = (top - 1) * self.step + F.size(F.filter(below, lambda t: t <= F.col("doc_id"))) + 2
        return F.when(F.col("doc_id").isNull(), 1).when(top == 0, 2).otherwise(fine)

    def is_hot(self) -> Column:
        return F.element_at(_longs(self.parts), self._range()) > 1 if self.hot else F.lit(False)

    def _mark(self) -> Column:
        """The hash that orders rows of a hot doc_id, 0 for other rows."""
        return F.when(self.is_hot(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if self.hot else F.lit(0).cast("long")

    def bucket(self) -> Column:
        at = self._range()
        offset = F.element_at(_longs(self.offsets), at)
        if not self.hot:
            return offset
        parts = F.element_at(_longs(self.parts), at)
        part = F.floor((self._mark().cast("double") / 2.0**64 + 0.5) * parts)
        return offset + F.least(part, parts - 1)

    def dealt(self, docs: DataFrame) -> DataFrame:
        """Adds ``bucket`` and ``ghost``; ghosts are the copies."""
        none = (None, None)
        ids, marks = ([self.first.get(b, none)[k] for b in range(self.size)] for k in (0, 1))
        before = _longs([self.before.get(b, -1) for b in range(self.size)])
        at = (F.col("_b") + 1).cast("int")
        own = F.struct(F.col("_b").cast("long").alias("bucket"), F.lit(False).alias("ghost"))
        copy = F.struct(F.element_at(before, at).alias("bucket"), F.lit(True).alias("ghost"))
        head = F.element_at(_longs(ids), at).eqNullSafe(F.col("doc_id"))
        if self.hot:
            head = head & (F.element_at(_longs(marks), at) == self._mark())
        rows = docs.withColumn("_b", self.bucket())
        rows = rows.withColumn("_to", F.explode(F.when(head, F.array(own, copy)).otherwise(F.array(own))))
        return rows.select(*docs.columns, "_to.bucket", "_to.ghost")


def _equal(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """1.0 where fingerprints are equal and so are the canonical bytes, else 0.0."""
    return F.when((fa == fb) & (canonical(a).cast("binary") == canonical(b).cast("binary")), 1.0).otherwise(0.0)


def edited_digests(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, mark: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document by descending doc_id (null last; rows of
    one doc_id by a hash of their text; the first follows the last).  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and the two
    likenesses, which are 1.0 or 0.0 for an exact digest.  A null text counts as
    empty; a single row is its own next; an empty table gives no rows.  Equal
    rows of a doc_id with many rows travel once, with their number.  ``mark``
    adds a wide digest of the canonical text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    deal = Neighbours(rows, bucket_rows)
    if deal.hot:
        folded = rows.where(deal.is_hot()).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.where(~deal.is_hot()).withColumn("copies", F.lit(1).cast("long")).unionAll(folded)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    dealt = deal.dealt(rows.withColumn("fp", digest(canonical(F.col("text")))))
    w = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    paired = dealt.withColumn("next", F.lead(F.struct("text", "fp")).over(w)).where("not ghost")
    if deal.hot:
        # All copies but the last are followed by a copy.
        copies = F.struct((F.col("copies") - 1).alias("copies"), F.struct("text", "fp").alias("next"))
        last = F.struct(F.lit(1).cast("long").alias("copies"), F.col("next"))
        paired = paired.withColumn("_to", F.explode(F.when(F.col("copies") > 1, F.array(copies, last)).otherwise(F.array(last))))
        paired = paired.select("doc_id", "text", "fp", "_to.next", "_to.copies")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    out = paired.withColumn("edited", edited).withColumn("efp", digest(canonical(F.col("edited"))))
    wide = [_mark().alias("mark")] if mark else []
    columns = [
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("efp").alias("edited_fingerprint"),
        _equal(F.col("text"), F.col("edited"), F.col("fp"), F.col("efp")).alias("near_edited"),
        _equal(F.col("text"), F.col("next.text"), F.col("fp"), F.col("next.fp")).alias("near_next"),
        *wide,
    ]
    if not deal.hot:
        return out.select(columns)
    out = out.select(*columns, "copies")
    names = [c for c in out.columns if c != "copies"]
    # In two levels, so that no array of copies grows with the table.
    out = out.withColumn("_from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    return out.withColumn("_k", F.explode(F.expr(f"sequence(_from, least(_from + {COPIES - 1}, copies - 1))"))).select(names)


def _mark() -> Column:
    return F.sha2(canonical(F.col("text")).cast("binary"), 512)


def grouped_digests(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``edited_digests`` with the group of each text: ``group_id`` (smallest doc_id, null if all are) and ``group_size``.

    Texts are compared byte for byte in canonical form.  Groups of more than
    ``HOT_ROWS`` rows reach their rows by broadcast where they are few, so no
    hot group waits in one task.
    """
    out = materialize(edited_digests(docs, bucket_rows), "digest-edited")
    rows = docs.select(F.col("doc_id").cast("long"), canonical(F.col("text").cast("string")).alias("canon"))
    groups, clash = _group_table(rows.withColumn("fingerprint", digest(F.col("canon"))), out)
    keys = ["fingerprint"]
    if not clash.isEmpty():
        out, keys = edited_digests(docs, bucket_rows, mark=True), ["fingerprint", "mark"]
    return _with_groups(out, groups, keys)


def _with_groups(out: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    columns = [c for c in out.columns if c != "mark"]
    own = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id")
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size")
    groups = groups.select(*keys, "group_id", "group_size")
    if groups.count() <= BROADCAST_ROWS:
        return out.join(F.broadcast(groups), keys, "left").select(*columns, own, size)
    hot = groups.where(F.col("group_size") > HOT_ROWS)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return out.join(groups, keys, "left").select(*columns, own, size)
    # Rows that have met their hot group go on under keys that meet nothing, dealt evenly.
    met = out.join(F.broadcast(hot.withColumnsRenamed({"group_id": "hot_id", "group_size": "hot_size"})), keys, "left")
    free = F.concat(F.lit("-"), F.xxhash64("doc_id", F.spark_partition_id()).cast("string"))
    met = met.withColumn("_key", F.when(F.col("hot_size").isNull(), F.col("fingerprint")).otherwise(free))
    rest = groups.where(F.col("group_size") <= HOT_ROWS).withColumnRenamed("fingerprint", "_key")
    met = met.join(rest, ["_key", *keys[1:]], "left")
    met = met.withColumns({"group_id": F.coalesce("group_id", "hot_id"), "group_size": F.coalesce("group_size", "hot_size")})
    return met.select(*columns, own, size)


def exact_groups(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Groups of rows whose canonical texts are equal byte for byte: doc_id, fingerprint, group_id, group_size.

    group_id is the smallest doc_id of the group, null if all are.  Only texts
    whose fingerprint occurs twice are compared, and equal ones meet already on
    the map side, so a group of any size shuffles one row per task.  ``key``
    replaces the fingerprint (of the column ``canon``), for tests with clashes.
    """
    key = digest(F.col("canon")) if key is None else key
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("canon", canonical(F.col("text"))).select("doc_id", "canon", key.alias("fingerprint"))
    prints = materialize(rows.select("doc_id", "fingerprint"), "digest-rows")
    return grouped(rows, prints)


def grouped(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """``rows``: doc_id, canon, fingerprint; ``prints``: the same rows without text, written."""
    groups, clash = _group_table(rows, prints)
    if clash.isEmpty():
        return _with_groups(prints, groups, ["fingerprint"])
    # Texts that differ under one fingerprint: those rows find their group by their text.
    split = rows.join(clash, "fingerprint", "left_semi").withColumn("mark", F.sha2(F.col("canon").cast("binary"), 512))
    split = split.join(groups, ["fingerprint", "mark"]).select("doc_id", "fingerprint", "group_id", "group_size")
    rest = prints.join(clash, "fingerprint", "left_anti")
    return _with_groups(rest, groups.join(clash, "fingerprint", "left_anti"), ["fingerprint"]).unionByName(split)


def _group_table(rows: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of two rows or more (fingerprint, mark, group_id, group_size), also of one row where a fingerprint has
    several texts; and the fingerprints of that kind."""
    counts = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counts.where("n > 1").select("fingerprint"), "digest-twice")
    small = twice.count() <= BROADCAST_ROWS
    same = rows.join(F.broadcast(twice) if small else twice, "fingerprint", "left_semi")
    groups = same.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumn("mark", F.sha2(F.col("canon").cast("binary"), 512))
    groups = materialize(groups.drop("canon"), "digest-groups")
    clash = groups.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fingerprint")
    return groups, materialize(clash, "digest-clash")
