"""op5 against a plain TF-IDF cosine and a walk up the directories."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rasterloom.llm import licenses
from rasterloom.llm.queries import op5_licence_scan

from .conftest import ODD


def words(line):
    return re.findall(r"[^\W_]+", line.lower())


def windows_of(text):
    """The stretches of tokens that templates would fill around anchors, each with its share of the text."""
    t, out = words(text or ""), {}
    for shape in {x for own in licenses.TEMPLATES.values() for x in own}:
        u = words(shape)
        anchors = [k for k, w in enumerate(u) if w in licenses.ANCHORS]
        for k in (anchors[0], anchors[-1]):
            for at in (i for i, w in enumerate(t) if w == u[k]):
                w = t[max(0, at - k) : max(0, at - k + len(u))]
                if len(set(w) & set(u)) >= licenses.SHARED * len(set(u)):
                    out[" ".join(w)] = len(w) / len(t)
    return out


def brute_lines(counts):
    """{line: times} to {line: (licence, score)}."""
    shapes = [(name, t) for name, own in licenses.TEMPLATES.items() for t in own]
    every = Counter(counts)
    every.update(t for t in {t for _, t in shapes})
    total, df = sum(every.values()), Counter()
    for line, n in every.items():
        for w in set(words(line)):
            df[w] += n
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in df.items()}

    def vector(line):
        return {w: n * idf[w] for w, n in Counter(words(line)).items()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    out = {}
    for line in counts:
        v, best = vector(line), None
        for name, t in shapes:
            u = vector(t)
            dot = sum(x * u.get(w, 0) for w, x in v.items())
            if dot:
                s = round(dot / (norm(v) * norm(u)), 6)
                if best is None or (-s, name) < best:
                    best = (-s, name)
        if best and -best[0] >= licenses.LEVEL:
            out[line] = (best[1], -best[0])
    return out


def brute_scan(files):
    """[(doc_id, path, text)] to {(doc_id, path, text): (licence, origin)}."""
    counts = Counter(line for _, _, t in set(files) for line in windows_of(t))
    scored = brute_lines(counts)
    own, votes = {}, {}
    for d, p, t in set(files):
        hits = {w: s for w, s in windows_of(t).items() if w in scored}
        if hits:
            own[d, p, t] = min((scored[w] for w in hits), key=lambda h: (-h[1], h[0]))[0]
            if p is not None and (max(hits.values()) >= licenses.FILE_SHARE or re.search(licenses.FILE_NAME, p)):
                votes.setdefault(p.rpartition("/")[0], Counter())[own[d, p, t]] += 1
    out = {}
    for d, p, t in files:
        if (d, p, t) in own:
            out[d, p, t] = (own[d, p, t], "own")
            continue
        at = None if p is None else p.rpartition("/")[0]
        while at is not None and at not in votes:
            at = at.rpartition("/")[0] if at else None
        out[d, p, t] = (min(votes[at].items(), key=lambda v: (-v[1], v[0]))[0], "inherited") if at is not None else (None, "none")
    return out


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/y.py", None), (4, "a/b/COPYING", "SPDX-License-Identifier: Apache-2.0"),
    (5, "a/b/c/z.py", "# SPDX-License-Identifier:   MIT\ncode\n" * 1 + "x = 1\n" * 50), (6, "z/none.txt", "nothing here"), (7, None, "no path"), (8, None, "Licensed under CC BY 4.0."),
    (9, "top.txt", "a file at the top"), (10, "a/ab/x", ""), (11, "q/LICENSE", "the word license in prose that no template has, really not at all"),
]


def frame(spark, files):
    return spark.createDataFrame([(d, p, t, "x", 0.0, "dir") for d, p, t in files], "doc_id bigint, path string, text string, license string, score double, dir string")


def check(rows, files):
    want = brute_scan(files)
    assert sorted((str(r.doc_id), str(r.path), str(r.license), r.origin) for r in rows) == sorted((str(d), str(p), str(want[d, p, t][0]), want[d, p, t][1]) for d, p, t in files)


def test_scan(spark):
    rows = licenses.scan(frame(spark, FILES)).collect()
    check(rows, FILES)
    found = {r.doc_id: r for r in rows}
    assert found[2].from_path == "a/b/COPYING" and found[10].from_path == "a/LICENSE" and found[5].origin == "own"


def test_odd_rows(spark):
    files = [(d, None if d is None else f"odd/{d}", t) for d, t in ODD] + [(50, "odd/LICENSE", "The MIT License (MIT)"), (50, "odd/LICENSE", "The MIT License (MIT)")]
    files += [(None, "same/path", "Released under the MIT License. And more text that follows here, of which there is plenty"), (None, "same/path", "no such thing")]
    files += [(60, "one/path", "Licensed under CC BY 4.0. Then a text that goes on and on for some more words than that"), (60, "one/path", "plain")]
    check(licenses.scan(frame(spark, files)).collect(), files)


def test_every_template_is_found(spark):
    """Whole, wrapped over commented lines, and inside a long line."""
    files, want = [], {}
    for name, own in licenses.TEMPLATES.items():
        for t in own:
            u = t.split(" ")
            forms = [t, "\n".join(" * " + " ".join(u[k : k + 7]) for k in range(0, len(u), 7)), "word after word " * 40 + t + " and so on" * 40]
            for f in forms:
                want[len(files)] = name
                files.append((len(files), f"f/{len(files)}/x", f))
    found = {r.doc_id: r for r in licenses.scan(frame(spark, files)).collect()}
    assert {k: r.license for k, r in found.items()} == want and all(r.origin == "own" and r.score > 0.9 for r in found.values())


def test_null_ids_keep_their_own_licence(spark, tmp_path):
    docs = [(None, "Released under the MIT License.", "web"), (None, "plain text", "web"), (None, None, None), (7, "Licensed under CC BY 4.0.", "web")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.license, r.origin) for r in op5_licence_scan(spark, str(tmp_path)).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [("MIT", "own"), (None, "none"), (None, "none"), ("CC-BY-4.0", "own")]))


def test_empty(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


def test_ties_fall_to_the_first_name(spark):
    rows = licenses.scan(frame(spark, [(1, "d/a", "Released under the MIT License."), (2, "d/b", "Licensed under CC BY 4.0."), (3, "d/c", "plain")])).collect()
    assert {r.doc_id: r.license for r in rows}[3] == "CC-BY-4.0"


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = [(r.doc_id, f"{r.source or 'unknown'}/{r.doc_id // 1000}/{r.doc_id // 100}/{r.doc_id}", r.text) for r in docs.collect()]
    out = op5_licence_scan(spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    check(rows, files)
    assert any(r.license for r in rows)


def test_path_may_be_any_expression(spark):
    docs = frame(spark, FILES).drop("path")
    assert licenses.scan(docs, F.lit(None)).where("origin = 'inherited'").count() == 0
