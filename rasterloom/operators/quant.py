"""Scalar quantisation by level, without loops.

The quality of a level doubles with its step up to the most that is useful, so
each cell's factor follows from its place: one Project for all levels.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Spec
from .lattice import level_step


def _factor(spec: Spec, chroma: Collection[int], low: int, shift: int):
    high = 1024 * spec.boost
    own = F.lit(spec.quality << shift)
    if chroma:
        own = F.when(F.col("c").isin(list(chroma)), spec.chroma_quality << shift).otherwise(own)
    step = level_step()
    q = F.greatest(F.lit(1), F.lit(low), F.least(F.lit(high), step.cast("bigint") * own))
    w, h = spec.downsampled(shift)
    return q, (step > 0) & (step < min(w, h)) & (q < high), high


def _apply(cells: DataFrame, q, on, changed: str) -> DataFrame:
    out = cells.withColumns({"_q": q, "_on": on})
    return out.withColumn("v", F.when(F.col("_on"), F.expr(changed)).otherwise(F.col("v")).cast("int")).drop("_q", "_on")


def quantize(cells: DataFrame, spec: Spec, chroma: Collection[int] = (), low: int = 0) -> DataFrame:
    q, on, high = _factor(spec, chroma, low, 0)
    return _apply(cells, q, on, f"(v * _q) div {high}")


def dequantize(cells: DataFrame, spec: Spec, chroma: Collection[int] = (), low: int = 0, downsampling: int = 0) -> DataFrame:
    q, on, high = _factor(spec, chroma, low, downsampling)
    return _apply(cells, q, on, f"(v * cast({high} as bigint) + sign(v) * {high // 2}) div _q".replace("sign(v)", "cast(sign(v) as bigint)"))
