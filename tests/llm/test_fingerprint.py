"""op4 against Python's own normalisation and order."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import fingerprint
from rasterloom.llm.queries import op4_canonical_digest

from .conftest import ODD


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def edited(text, after):
    n = len(text)
    return text[: n - n // 2] + after[: n // 2]


def expected(docs):
    """Rows of one id may stand in either order, so those ids are left out of the exact comparison."""
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited(t, after)
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(after)))
    return out


@pytest.mark.parametrize("bucket_rows", [2, 500])
def test_edited_digests(docs_of, bucket_rows):
    docs = [r for r in dict(ODD).items() if r[0] is not None]
    rows = fingerprint.edited_digests(docs_of(docs), bucket_rows).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == expected(docs)


def test_canonical_forms(docs_of):
    texts = ["Straße", "STRASSE", "ﬁne  Text", "FINE\ttext ", "é", "É", "Ｆｕｌｌ", "full", "İ", "a b", "A B", "ς", "Σ", "", None, "  "]
    rows = fingerprint.exact_groups(docs_of(list(enumerate(texts)))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.group_id, set()).add(r.doc_id)
    want = {}
    for k, t in enumerate(texts):
        want.setdefault(canonical(t), set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(r.group_size == len(got[r.group_id]) and r.group_id == min(got[r.group_id]) for r in rows)


def test_clashing_fingerprints(docs_of):
    """With a digest of two values only, bytes still tell texts apart."""
    docs = [(k, f"text {k % 5}") for k in range(20)]
    rows = fingerprint.exact_groups(docs_of(docs), F.substring("canon", -1, 1).cast("int").bitwiseAND(1).cast("string")).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in rows) == [(k, k % 5, 4) for k in range(20)]


def test_odd_rows(odd):
    rows = fingerprint.edited_digests(odd, 3).collect()
    assert len(rows) == len(ODD)
    by = {}
    for d, t in ODD:
        by.setdefault(canonical(t), set())
    prints = {}
    for r, (d, t) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_chars)), sorted(ODD, key=lambda r: (str(r[0]), len(r[1] or "")))):
        prints.setdefault(canonical(t), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    groups = fingerprint.exact_groups(odd).collect()
    assert len(groups) == len(ODD)


def test_hot_ids(docs_of):
    """Rows without an id, and of one id, spread over buckets by a hash of their text; copies keep their number."""
    import xxhash

    docs = [(None, f"none {k % 40}") for k in range(90)] + [(7, f"Seven {k % 5}") for k in range(61)]
    docs += [(2**63 - 1, f"top {k}") for k in range(9)] + [(k, f"text {k}") for k in range(30)] + [(11, None)]
    key = lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63 & 2**64 - 1)
    order = sorted(docs, key=key)
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited(t, after)
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(after))))
    for rows in (3, 8, 25):
        got = fingerprint.edited_digests(docs_of(docs), rows).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)


def test_more_copies_than_an_array_takes(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "COPIES", 4)
    docs = [(None, "same")] * 23 + [(1, "other")]
    assert fingerprint.edited_digests(docs_of(docs), 5).count() == 24


@pytest.mark.parametrize("hot_rows, broadcast_rows", [(10_000, 200_000), (2, 3), (2, 0)])
def test_groups_reach_their_rows(docs_of, monkeypatch, hot_rows, broadcast_rows):
    """The three ways in which groups meet rows give the same groups as a dictionary."""
    monkeypatch.setattr(fingerprint, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(fingerprint, "BROADCAST_ROWS", broadcast_rows)
    docs = [(k, f"A  text {max(0, k - 30) // 2}") for k in range(40)] + [(None, "no id"), (None, "No Id"), (3, "a text 0")]
    want = {}
    for d, t in docs:
        want.setdefault(canonical(t), []).append(d)
    expect = []
    for ids in want.values():
        low = min((d for d in ids if d is not None), default=None)
        expect += [(str(d), str(low), len(ids)) for d in ids]
    rows = fingerprint.grouped_digests(docs_of(docs)).collect()
    assert sorted((str(r.doc_id), str(r.group_id), r.group_size) for r in rows) == sorted(expect)


def test_groups_with_clashing_fingerprints(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda canon: F.substring(canon, 1, 1))
    rows = fingerprint.grouped_digests(docs_of([(k, f"text {k % 5}") for k in range(20)])).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in rows) == [(k, k % 5, 4) for k in range(20)]


def test_empty_and_single(empty, docs_of):
    assert fingerprint.edited_digests(empty).count() == 0 and fingerprint.exact_groups(empty).count() == 0
    one = fingerprint.edited_digests(docs_of([(5, "abcd")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op4_canonical_digest(spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == expected(docs)
    texts, prints, members = dict(docs), {}, {}
    for d, t in docs:
        members.setdefault(canonical(t), []).append(d)
    assert all((r.group_id, r.group_size) == (min(m), len(m)) for r in rows for m in [members[canonical(texts[r.doc_id])]])
    for r in rows:
        prints.setdefault(r.fingerprint, set()).add(canonical(texts[r.doc_id]))
    assert all(len(p) == 1 for p in prints.values()) and len(prints) == len({canonical(t) for t in texts.values()})
