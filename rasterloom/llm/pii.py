"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are spans of four base patterns.  Candidates are all words with a digit
or an at sign, of any length.  The two words before a mention are its lexical
pattern, each by its last ``WORD`` characters; earlier mentions and candidates
between are passed over, so all items of a list have the pattern of the first,
and punctuation may take the place of white space before the mention.  A mention
with fewer than two words in the ``LEFT`` characters before it has no pattern.

Patterns and instances form a graph.  A pattern's confidence in a kind is the
share of its mentions whose instances are known to be of that kind: seeds
wholly, others as well as their best accepted pattern other than this one, so
no pattern speaks for itself.  A pattern is accepted with a confidence of
``CONFIDENCE`` or more and ``SUPPORT`` or more distinct instances known so;
what it accepts supports further patterns in the next round, until a round adds
none or after ``ROUNDS``.  Rounds are grouped sums over the distinct mentions.
Accepted patterns then mark identifiers that no base pattern describes.

Positions come from the gaps between matches: ``split`` and
``regexp_extract_all`` walk a text alike.  Possessive groups keep Java's matcher
from recursing, and look-behinds keep it linear on long runs; neither changes
what matches.  Running sums over the matches of a text are taken in blocks, and
text is cut in an encoding of fixed width, so a text with very many matches
costs no more than its length.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_PARTS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
NEEDS = {"email": "@", "phone": "+"}  # a character without which there is no match
CANDIDATE = r"(?<![\w@.+-])(?=[A-Za-z_.+-]*+[0-9@])[\w@.+-]++"
LEFT, WORD = 192, 40
ROUNDS, CONFIDENCE, SUPPORT = 6, 0.8, 5
BROADCAST_SPANS = 200_000
BLOCK, OUTER = 64, 4096
_SPAN = "struct<start:int,end:int,v:string,left:string>"
_ADDED = "array<struct<kind:string,start:int,end:int>>"


def _blocks(array: str) -> str:
    """The array in blocks of BLOCK elements.

    A fold copies what it has gathered at each step and a slice reads its whole
    array, so folds stay within a block, and blocks are cut from longer pieces.
    """
    cut = lambda a, n: f"transform(sequence(0, (size({a}) - 1) div {n}), k -> slice({a}, k * {n} + 1, {n}))"
    return f"if(size({array}) = 0, array(), flatten(transform({cut(array, OUTER)}, o -> {cut('o', BLOCK)})))"


def _running_max(blocks: str, value: str, floor: str) -> Column:
    """The highest ``value`` (of element x) up to each element of an array, given in blocks."""
    return F.expr(
        f"""flatten(zip_with({blocks},
          aggregate(transform({blocks}, c -> array_max(transform(c, x -> {value}))),
            named_struct('top', {floor}, 'out', cast(array() as array<int>)),
            (acc, x) -> named_struct('top', greatest(acc.top, x), 'out', array_append(acc.out, acc.top)), acc -> acc.out),
          (c, from) -> aggregate(c, named_struct('top', from, 'out', cast(array() as array<int>)),
            (acc, x) -> named_struct('top', greatest(acc.top, {value}), 'out', array_append(acc.out, greatest(acc.top, {value}))), acc -> acc.out)))"""
    )


def _matches() -> Column:
    """Array of (start, end, v, left) from blocks ``b_`` of (gap, len, v, left): code points, end exclusive, the match and up to
    ``LEFT`` characters before it without earlier matches."""
    return F.expr(
        f"""flatten(zip_with(b_,
          aggregate(
            transform(b_, c -> named_struct('len', aggregate(c, 0, (n, x) -> n + x.gap + x.len), 'tail', right(array_join(transform(c, x -> x.left), ''), {LEFT}))),
            named_struct('pos', 0, 'tail', '', 'out', cast(array() as array<struct<pos:int,tail:string>>)),
            (acc, x) -> named_struct('pos', acc.pos + x.len, 'tail', right(concat(acc.tail, x.tail), {LEFT}),
               'out', array_append(acc.out, named_struct('pos', acc.pos, 'tail', acc.tail))),
            acc -> acc.out),
          (c, from) -> aggregate(c,
            named_struct('pos', from.pos, 'tail', from.tail, 'out', cast(array() as array<{_SPAN}>)),
            (acc, x) -> named_struct('pos', acc.pos + x.gap + x.len, 'tail', right(concat(acc.tail, x.left), {LEFT}), 'out', array_append(acc.out,
               named_struct('start', acc.pos + x.gap, 'end', acc.pos + x.gap + x.len, 'v', x.v, 'left', right(concat(acc.tail, x.left), {LEFT})))),
            acc -> acc.out)))"""
    )


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x["v"], "[^0-9]", "")
    if kind == "ip":
        return x["v"].rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _with_matches(rows: DataFrame, name: str, pattern: str, need: Column | None = None) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    rows = rows.withColumn("m_", found if need is None else F.when(need, found).otherwise(none))
    rows = rows.withColumn("s_", F.when(F.size("m_") > 0, F.split("text", pattern, -1)).otherwise(none))
    gaps = f"zip_with(slice(s_, 1, size(m_)), m_, (a, b) -> named_struct('gap', length(a), 'len', length(b), 'v', b, 'left', right(a, {LEFT})))"
    rows = rows.withColumn("s_", F.expr(gaps)).withColumn("b_", F.expr(_blocks("s_")))
    found = F.when(F.size("m_") > 0, _matches()).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    return rows.withColumn(name, found).drop("m_", "s_", "b_")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, key and one array of base spans for each kind; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, pattern in KINDS.items():
        rows = _with_matches(rows, kind, pattern, F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else None)
        rows = rows.withColumn(kind, F.filter(kind, partial(_valid, kind)))
    return rows.withColumn("key", row_key())


def row_key() -> Column:
    """Equal for equal rows only, but for hash clashes within one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text))


def _context(left: Column) -> Column:
    bare = F.regexp_replace(left, CANDIDATE, "")
    text = F.regexp_replace(bare, r"[^\p{L}\p{N}_]+$", "")
    words = F.split(text, r"\s+")
    last = F.transform(F.slice(F.concat(F.array(F.lit(""), F.lit("")), words), -2, 2), lambda w: F.right(w, F.lit(WORD)))
    shape = F.regexp_replace(F.lower(F.array_join(last, " ")), "[0-9]+", "#")
    whole = (F.length(text) < F.length(bare)) & ~F.exists(last, lambda w: w == "")
    return F.when(whole, shape)


def mentions(spans: DataFrame) -> DataFrame:
    """Base spans and candidates with their contexts: key, kind (null: candidate), start, end, context, value."""
    digits = spans.where(F.col("text").rlike("[0-9@]"))
    rows = _with_matches(digits, "cand", CANDIDATE)
    every = F.concat(*[F.col(k) for k in KINDS])
    rows = rows.withColumn("base", every)
    # Along all spans by their start: how far base spans reach so far, and where the next one begins.
    events = "transform(base, x -> named_struct('start', x.start, 't', 0, 'end', x.end, 'v', '', 'left', ''))"
    events += ", transform(cand, x -> named_struct('start', x.start, 't', 1, 'end', x.end, 'v', x.v, 'left', x.left))"
    both = F.when(F.size("base") * F.size("cand") > 0, F.expr(f"sort_array(concat({events}))"))
    rows = rows.withColumn("e_", both).withColumn("r_", F.reverse("e_"))
    rows = rows.withColumn("b_", F.expr(_blocks("e_"))).withColumn("r_", F.expr(_blocks("r_")))
    rows = rows.withColumn("reach", _running_max("b_", "if(x.t = 0, x.end, -1)", "-1"))
    rows = rows.withColumn("ahead", _running_max("r_", "if(x.t = 0, -x.start, -2147483647)", "-2147483647"))
    clear = "filter(e_, (x, i) -> x.t = 1 and get(reach, i) <= x.start and -get(ahead, size(ahead) - 1 - i) >= x.end)"
    free = F.expr(f"if(e_ is null, cand, transform({clear}, x -> named_struct('start', x.start, 'end', x.end, 'v', x.v, 'left', x.left)))")
    tagged = [_named(F.col(k), F.lit(k)) for k in KINDS] + [_named(free, F.lit(None).cast("string"))]
    out = rows.select("key", F.explode(F.concat(*tagged)).alias("x"))
    value = F.xxhash64(F.lower("x.s.v"))
    out = out.select("key", "x.kind", "x.s.start", "x.s.end", _context(F.col("x.s.left")).alias("context"), value.alias("value"))
    return out.where("context is not null")


def _named(array: Column, kind: Column) -> Column:
    return F.transform(array, lambda x: F.struct(kind.alias("kind"), x.alias("s")))


def _of_kind(array: Column, kind: str) -> Column:
    return F.sort_array(F.filter(array, lambda x: x["kind"] == kind))


def discover(found: DataFrame) -> DataFrame:
    """Candidate mentions that accepted patterns mark: key, kind, start, end."""
    edges = found.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"))
    edges = materialize(edges, "pii-all-edges")
    # Without that many distinct instances a pattern can't be accepted in any round.
    enough = edges.groupBy("context").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).where(F.col("k") >= SUPPORT)
    edges = materialize(edges.join(enough.drop("k"), "context"), "pii-edges")
    seeds = materialize(found.where("kind is not null").select("value", "kind").distinct(), "pii-seeds")
    first = edges.join(seeds, "value").select("context", "value", "kind", "n", "total", F.lit(1.0).alias("score"))
    accepted = _accepted(first)
    for _ in range(ROUNDS):
        claims = edges.join(accepted, "context").select("context", "value", "kind", "confidence")
        claims = claims.join(seeds, ["value", "kind"], "left_anti")
        # The best pattern of each instance, and for that pattern itself the best of the others.
        top = claims.groupBy("value", "kind").agg(F.max(F.struct("confidence", "context")).alias("top"))
        top = materialize(top, "pii-top")
        other = claims.join(top, ["value", "kind"]).where("context <> top.context").groupBy("value", "kind").agg(F.max("confidence").alias("other"))
        known = edges.join(top, "value").join(other, ["value", "kind"], "left")
        score = F.when(F.col("top.context") == F.col("context"), F.col("other")).otherwise(F.col("top.confidence"))
        learned = known.select("context", "value", "kind", "n", "total", score.alias("score")).where("score is not null")
        after = _accepted(first.unionByName(learned))
        grown = after.join(accepted, ["context", "kind"], "left_anti").isEmpty()
        accepted = after
        if grown:
            break
    best = accepted.groupBy("context").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    marked = found.where("kind is null").drop("kind").join(best, "context")
    return materialize(marked.select("key", "kind", "start", "end").distinct(), "pii-added")


def _accepted(known: DataFrame) -> DataFrame:
    """context, kind and confidence of the patterns that known instances (context, value, kind, n, total, score) confirm."""
    sure = F.count(F.when(F.col("score") >= CONFIDENCE, 1))
    sums = known.groupBy("context", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("confidence"), sure.alias("support"))
    return materialize(sums.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).drop("support"), "pii-patterns")


def _labels(array: Column) -> Column:
    return F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def added_spans(spans: DataFrame) -> DataFrame:
    """key and the array ``added`` of (kind, start, end) that the method finds beside the base spans."""
    found = materialize(mentions(spans), "pii-mentions")
    extra = discover(found)
    return extra.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of each row.

    Spans are ``kind:start:end`` by kind as listed, then start, comma-joined;
    ``base_sha256`` is the digest of the base spans written so, and ``spans``
    holds those and what the method adds.  Null and empty texts have none;
    repeated rows are all returned.
    """
    spans = base_spans(docs)
    base = F.concat(*[_tagged(k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    written = materialize(spans.select("doc_id", "key", *counts, base.alias("base")), "pii-base")
    extra = added_spans(spans)
    rows = written.join(extra, "key", "left")
    both = F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {_ADDED})")))
    ordered = F.concat(*[_of_kind(both, k) for k in KINDS])
    return rows.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(F.array_join(_labels(F.col("base")), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(_labels(ordered), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]`` and n_chars brought up to date; all columns stay."""
    spans = base_spans(docs)
    extra = materialize(added_spans(spans), "pii-added-rows")
    small = (extra.agg(F.sum(F.size("added")).alias("n")).first()["n"] or 0) <= BROADCAST_SPANS
    rows = docs.withColumn("_key", row_key()).withColumn("_doc", F.col("doc_id"))
    keep = [c for c in docs.columns if c not in ("text", "doc_id")]
    rows = rows.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)], "_doc", "text", F.col("doc_id"))
    rows = rows.withColumn("_null", F.col("text").isNull()).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    for kind, pattern in KINDS.items():
        rows = _with_matches(rows, kind, pattern, F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else None)
        rows = rows.withColumn(kind, F.filter(kind, partial(_valid, kind)))
    rows = rows.withColumn("key", row_key()).join(F.broadcast(extra) if small else extra, "key", "left")
    every = F.concat(*[_tagged(k) for k in KINDS], F.coalesce("added", F.expr(f"cast(array() as {_ADDED})")))
    by_start = F.sort_array(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.withColumn("all_", by_start).withColumn("b_", F.expr(_blocks("all_")))
    # How far spans reach up to each one, by blocks.
    rows = rows.withColumn("reach", _running_max("b_", "x.end", "0"))
    # Spans that overlap become one, under the kind of the first.
    heads = "filter(all_, (x, i) -> i = 0 or x.start >= get(reach, i - 1))"
    tails = "filter(reach, (x, i) -> i = size(reach) - 1 or get(all_, i + 1).start >= x)"
    merged = F.expr(f"zip_with({heads}, {tails}, (x, e) -> named_struct('start', x.start, 'end', e, 'kind', x.kind))")
    rows = rows.withColumn("all_", F.when(F.size("all_") > 0, merged).otherwise(F.col("all_")))
    # Four bytes a code point, so a piece is found without a walk from the start of the text.
    rows = rows.withColumn("wide_", F.expr("if(size(all_) > 0 and is_valid_utf8(text), encode(text, 'UTF-32'), null)"))
    cut = lambda a, n: f"if(wide_ is null, substring(text, {a} + 1, {n}), decode(substring(wide_, 4 * ({a}) + 1, 4 * ({n})), 'UTF-32'))"
    last = "if(i = 0, 0, get(all_, i - 1).end)"
    pieces = F.expr(
        f"""concat(array_join(transform(all_, (x, i) -> concat({cut(last, f'x.start - {last}')}, '[', upper(x.kind), ']')), ''),
             {cut('element_at(all_, -1).end', 'length(text)')})"""
    )
    clean = F.when(F.size("all_") == 0, F.col("text")).otherwise(pieces)
    rows = rows.withColumn("text", F.when(~F.col("_null"), clean))
    back = {c: F.col(f"_c{k}") for k, c in enumerate(keep)} | {"doc_id": F.col("_doc"), "text": F.col("text")}
    if "n_chars" in back:
        kind = docs.schema["n_chars"].dataType
        back["n_chars"] = F.when(F.col("_null"), back["n_chars"]).otherwise(F.length("text").cast(kind))
    return rows.select(*[back[c].alias(c) for c in docs.columns])
