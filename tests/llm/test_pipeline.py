"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import numpy as np

import corpus_pipeline
from rasterloom.llm import decontaminate, simhash
from rasterloom.llm.storage import materialize, table

from .test_pii import brute
from .test_simhash import brute_fingerprint, brute_groups, shingles
from .test_tokens_and_packing import check_pieces, library


def similar_pairs(texts, level):
    """Pairs of documents with that share of common five-word shingles, by an inverted index."""
    own, index, common = {d: shingles(t) for d, t in texts.items()}, {}, Counter()
    for d, grams in sorted(own.items()):
        for g in grams:
            for other in index.setdefault(g, []):
                common[other, d] += 1
            index[g].append(d)
    scores = {(a, b): n / (len(own[a]) + len(own[b]) - n) for (a, b), n in common.items()}
    return {p: s for p, s in scores.items() if s >= level}


def merged(texts, pairs, start):
    label = {d: start[d] for d in texts}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            a, b = label[a], label[b]
            if a != b:
                label = {d: min(a, b) if x in (a, b) else x for d, x in label.items()}
                changed = True
    return label


def test_stages(spark, larger_dir):
    docs = table(spark, larger_dir, "documents")
    columns = docs.columns
    inputs, outputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = outputs[name] = materialize(stage(spark, docs, larger_dir), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in outputs.items() if n != "packing"}
    assert len(ids["toxicity"]) > len(ids["near_copies"]) > len(ids["decontamination"]) == len(ids["personal_data"]) > 0

    labels = {r.doc_id: r.toxic for r in table(spark, larger_dir, "labels").collect()}
    left = set(ids["toxicity"])
    gone = [d for d, y in labels.items() if y == 1 and d not in left]
    assert len(gone) >= 0.55 * sum(y == 1 for y in labels.values())  # from some 30 toxic examples; test_classifiers has more
    assert np.mean([d in left for d, y in labels.items() if y == 0]) >= 0.97

    texts = {r.doc_id: r.text for r in inputs["near_copies"].collect()}
    kept = set(ids["near_copies"])
    near = similar_pairs(texts, 0.65)
    by_bits = brute_groups({d: brute_fingerprint(t) for d, t in texts.items()})
    tight = merged(texts, [p for p, s in near.items() if s >= 0.8], by_bits)
    loose = merged(texts, near, by_bits)
    assert kept <= set(tight.values()) and {loose[d] for d in kept} == set(loose.values())

    leaks = decontaminate.leaks(inputs["decontamination"], table(spark, larger_dir, "benchmark"))
    bad = {r.doc_id for r in leaks.collect()}
    assert sorted(ids["decontamination"]) == sorted(set(ids["near_copies"]) - bad)

    before = {r.doc_id: r.text for r in inputs["personal_data"].collect()}
    for r in outputs["personal_data"].collect():
        assert not any(brute(r.text)[k] for k in ("email", "ip")) and r.n_chars == len(r.text or "")
        if not any(brute(before[r.doc_id]).values()) and "[" not in r.text:
            assert r.text == before[r.doc_id]

    texts = [(r.doc_id, r.text) for r in inputs["packing"].collect()]
    check_pieces(outputs["packing"].collect(), texts, library("byte_bpe_50k.json"))


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert simhash.RADIUS == 3 and simhash.LEVEL == 0.8 and len(corpus_pipeline.STAGES) == 5
