"""op7: base spans against a plain scanner, discovery on planted contexts, and redaction."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pii
from rasterloom.llm.queries import op7_bootstrapped_pii

from .conftest import ODD

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c.@d.e", "a@b.c@d.e", "@a.b x@y", "x@y.z. and x@-.-", "%@a.b+c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1.2.3.0255 1.2.3", "..1.2.3.4..",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "0000000000000 1", "12345678901234567890", "+1 (555) 123-4567", "+1 555 123 45678 90 12345",
    "+12345678 +1.2.3.4", "++1 23456789", "+1 (", "é 漢 \U0001f600 a@b.co \U0001f600 10.0.0.1", "tel:+49-30-1234567.", "a" * 500 + "@" + "b" * 500, "1" * 3000, "-".join("1" * 600), "+" + "1 " * 900,
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "", re.ASCII) if good(k, m[0])] for k, p in PLAIN.items()}


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in sorted(spans[k]))


def check(rows, docs):
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = []
    for d, t in docs:
        spans = brute(t)
        want.append((str(d), *(len(spans[k]) for k in PLAIN), hashlib.sha256(written(spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_base_spans(docs_of):
    docs = [*ODD, *((100 + k, t) for k, t in enumerate(HARD)), (900, " ".join(HARD)), (901, "\n".join(reversed(HARD)))]
    check(pii.find_pii(docs_of(docs)).collect(), docs)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_bootstrapped_pii(spark, sf_dir).collect()
    check(rows, docs.items())
    for r in rows:
        base = written(brute(docs[r.doc_id])).split(",")
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert r.spans == ",".join(sorted(r.spans.split(","), key=lambda s: s and (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2]))))


def planted(many=8):
    seeds = [(k, f"Hello. Please write to user{k}@mail{k}.example.com about it.") for k in range(many)]
    new = [(100, "Hello. Please write to jane_at_host42 about it."), (101, "The number of houses is house4242 here.")]
    return seeds + new


def test_patterns_discover(docs_of):
    rows = {r.doc_id: r.spans for r in pii.find_pii(docs_of(planted())).collect()}
    text = planted()[-2][1]
    at = text.index("jane")
    assert rows[100] == f"email:{at}:{at + len('jane_at_host42')}" and rows[101] == ""
    assert all(rows[k].count("email") == 1 for k in range(8))


@pytest.mark.parametrize(
    "text, values",
    [
        ("Please write to ab_12345, cd_67890, ef_11111 about it.", ["ab_12345", "cd_67890", "ef_11111"]),
        ("Please write to x1@y1.org jane_at_host42 soon.", ["x1@y1.org", "jane_at_host42"]),
        ("Please write to 4111 1111 1111 1111, jane_at_host42 soon.", ["jane_at_host42"]),
        ("Please write to=ab_12345 soon.", ["ab_12345"]),
        ("Please write to:(cd_67890) soon.", ["cd_67890"]),
        ("Please write to " + "long_" * 40 + "1 soon.", ["long_" * 40 + "1"]),
        ("Please write to a1 soon.", ["a1"]),
    ],
)
def test_every_mention_has_a_context(docs_of, text, values):
    """Items of a list, mentions after others, glued ones, short and long ones; seeds are over 0.8 of the pattern's mentions."""
    docs = [*planted(16)[:16], (100, text)]
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs_of(docs)).collect()}[100]
    assert [s for s in spans.split(",") if s.startswith("email")] == [f"email:{text.index(v)}:{text.index(v) + len(v)}" for v in values]


def spread(context, values, start, every=1):
    return [(start + k, f"Hello. {context} {v} about it, thank you." * every) for k, v in enumerate(values)]


def test_a_chain_of_patterns_is_found(docs_of):
    """Identifiers that a seeded pattern accepts carry a pattern without any seed, and that one finds others."""
    ids, others = [f"acct_{k}x" for k in range(12)], ["cust-7-z"]
    docs = spread("Please write to", [f"u{k}@m{k}.example.org" for k in range(100)], 0) + spread("Please write to", ids, 100)
    docs += spread("The owner of", ids, 200) + spread("The owner of", others, 300)
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs_of(docs)).collect()}
    text = docs[-1][1]
    assert spans[300] == f"email:{text.index('cust')}:{text.index('cust') + len(others[0])}"
    assert all(spans[100 + k].startswith("email:") and spans[200 + k].startswith("email:") for k in range(12))


def test_a_pattern_does_not_speak_for_itself(docs_of):
    """With under half of its mentions known, a pattern marks nothing, however many rounds there are."""
    docs = spread("Please write to", [f"u{k}@m{k}.example.org" for k in range(9)], 0) + spread("Please write to", [f"house{k}" for k in range(11)], 100)
    assert all(r.spans == "" for r in pii.find_pii(docs_of(docs)).where("doc_id >= 100").collect())


def brute_added(docs):
    """Spans that patterns add, from loops over plain dictionaries: {doc_id: {(kind, start, end)}}."""
    cand = re.compile(r"(?<![\w@.+-])(?=[A-Za-z_.+-]*[0-9@])[\w@.+-]+", re.ASCII)
    rows = []
    for d, t in docs:
        base = {k: v for k, v in brute(t).items()}
        taken = [s for v in base.values() for s in v]
        free = [(m.start(), m.end()) for m in cand.finditer(t or "")]
        streams = [(k, [(m.start(), m.end()) for m in re.finditer(PLAIN[k], t or "", re.ASCII)], set(v)) for k, v in base.items()]
        streams.append((None, free, {(a, b) for a, b in free if not any(x < b and a < y for x, y in taken)}))
        for kind, every, good_ones in streams:
            left, at = "", 0
            for a, b in every:
                left = (left + t[at:a])[-pii.LEFT :]
                at = b
                if (a, b) in good_ones:
                    bare = cand.sub("", left)
                    text = re.sub(r"[\W]+$", "", bare)
                    words = re.split(r"[ \t\n\x0b\f\r]+", text)[-2:]
                    if len(text) < len(bare) and len(words) == 2 and all(words):
                        context = re.sub("[0-9]+", "#", " ".join(w[-pii.WORD :] for w in words).lower())
                        rows.append((d, kind, a, b, context, t[a:b].lower()))
    seeds = {(r[5], r[1]) for r in rows if r[1]}
    n, total = {}, {}
    for *_, c, v in rows:
        n[c, v] = n.get((c, v), 0) + 1
        total[c] = total.get(c, 0) + 1
    accepted = {}
    for _ in range(pii.ROUNDS + 1):
        new = {}
        for c in total:
            for kind in PLAIN:
                score = {}
                for (c2, v), _k in n.items():
                    if c2 == c:
                        others = [conf for (c3, k3), conf in accepted.items() if k3 == kind and c3 != c and (c3, v) in n]
                        score[v] = 1.0 if (v, kind) in seeds else max(others, default=0.0)
                conf = sum(n[c, v] * s for v, s in score.items()) / total[c]
                if conf >= pii.CONFIDENCE and sum(s >= pii.CONFIDENCE for s in score.values()) >= pii.SUPPORT:
                    new[c, kind] = conf
        accepted, stop = new, set(new) <= set(accepted)
        if stop:
            break
    out = {}
    for d, kind, a, b, c, _v in rows:
        best = max(((conf, k) for (c2, k), conf in accepted.items() if c2 == c), default=None)
        if kind is None and best:
            out.setdefault(d, set()).add((best[1], a, b))
    return out


def test_added_spans_equal_plain_loops(docs_of):
    rng = random.Random(12)
    values = [f"u{k}@m.example.org" for k in range(12)] + [f"10.0.0.{k}" for k in range(12)] + [f"id_{k}" for k in range(12)]
    contexts = ["write to", "reach me", "host is", "number 17 of", "kept by"]
    favour = {c: rng.sample(values[k % 3 * 12 : k % 3 * 12 + 12], 9) + ["id_1", "id_2"] for k, c in enumerate(contexts)}
    docs = []
    for d in range(260):
        parts = []
        for _ in range(rng.randint(1, 3)):
            c = rng.choice(contexts)
            parts.append(f"now {c} " + ", ".join(rng.choices(favour[c], weights=[9] * 9 + [1, 1], k=rng.randint(1, 2))))
        docs.append((d, ". ".join(parts) + rng.choice(["", ".", " \u00e9nd"])))
    want = brute_added(docs)
    assert sum(map(len, want.values())) > 5
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.find_pii(docs_of(docs)).collect()}
    for d, t in docs:
        both = [f"{k}:{a}:{b}" for k, v in brute(t).items() for a, b in v] + [f"{k}:{a}:{b}" for k, a, b in want.get(d, ())]
        assert got[d] - {""} == set(both), (d, t)


def test_a_text_with_very_many_matches(docs_of):
    """20,000 numbers, 4,000 mail addresses and as many candidates: time is in proportion, not to the square."""
    text = " ".join(f"n{k} 10.0.{k % 256}.{k // 256 % 256}" + (f" u{k}@x.org" if k % 5 == 0 else "") for k in range(20_000))
    start = time.time()
    row = pii.find_pii(docs_of([(1, text)])).collect()[0]
    assert row.n_ip == 20_000 and row.n_email == 4_000
    out = pii.redact(docs_of([(1, text)])).collect()[0].text
    assert out == " ".join(f"n{k} [IP]" + (" [EMAIL]" if k % 5 == 0 else "") for k in range(20_000))
    assert time.time() - start < 300


def test_redact(docs_of):
    docs = [*planted(), *ODD, (200, "Call +1 (555) 123-4567 or 10.0.0.1, \U0001f600 a@b.co")]
    source = docs_of(docs)
    out = pii.redact(source)
    assert out.columns == source.columns and out.schema["n_chars"].dataType == source.schema["n_chars"].dataType
    rows = out.collect()
    assert len(rows) == len(docs)
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert found[200].text == "Call [PHONE] or [IP], \U0001f600 [EMAIL]" and found[200].n_chars == len(found[200].text)
    assert found[100].text == "Hello. Please write to [EMAIL] about it."
    assert found[1].text is None and found[2].text == "" and found[101].text == planted()[-1][1]
    assert sorted(str(r.text) for r in rows if r.doc_id == 6 and "Hello" not in r.text) == ["one two three"] * 2


def test_overlaps_become_one(docs_of):
    row = pii.redact(docs_of([(1, "x +1.2.3.4555555 y 4111 1111 1111 1111@a.b z")])).collect()[0]
    assert "4555" not in row.text and "1111" not in row.text


def test_empty(empty):
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_no_python_in_plans(docs_of):
    for out in (pii.find_pii(docs_of(ODD)), pii.redact(docs_of(ODD))):
        assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("value", ["4111111111111111", "5500000000000004", "1234567890123"])
def test_luhn(spark, value):
    assert spark.range(1).select(F.call_function("luhn_check", F.lit(value))).first()[0] == luhn(value)
