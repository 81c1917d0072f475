"""Texts lifted as bytes: sums against the kernels, and the plan."""

import numpy as np
import pytest

from rasterloom import catalog
from rasterloom.functions import kernels

TEXTS = ["a", "", None, "zq", "añ€𝄞 " * 30, "\x7f\x00" * 50, "abc", "x" * 101, "߿" * 64]


def want(text: str) -> tuple[int, int, int]:
    v = kernels.lift(np.frombuffer(text.encode(), np.uint8)[None].astype(np.int32), "linear", 1)[0].astype(np.int64)
    return len(v), int(v.sum()), int((v * np.arange(1, len(v) + 1)).sum())


@pytest.mark.parametrize("most", [1, 3, 8, 100, 1 << 20])
def test_sums_in_pieces(most):
    lines = [t.encode() for t in TEXTS if t]
    total, weighted = kernels.lift_line_sums(np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)]), most)
    assert [(len(b), int(t), int(w)) for b, t, w in zip(lines, total, weighted)] == [want(t) for t in TEXTS if t]


def test_query_makes_no_row_of_a_byte(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["text_lift_l1"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    assert {r.image_id: (r.n, r.total, r.weighted) for r in rows.collect()} == {i: want(t) for i, t in enumerate(TEXTS) if t}
