"""Context moments of every detail: weighted means of the magnitudes around it that a decoder already knows.

Each target names its sources and their weights by expression; one equi-join
fetches their values and one grouped sum weighs them.  No Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import FAR, NEAR, WORD
from ..spec import Spec
from .lattice import BLOCK, with_blocks


def _source(y: Column, x: Column, weight: int, known: Column) -> Column:
    return F.when(known, F.struct(y.cast("int").alias("sy"), x.cast("int").alias("sx"), F.lit(weight).alias("weight")))


def _sources(spec: Spec) -> Column:
    """Places in block coordinates ``ly, lx``; ``h, w`` are the block's sides."""
    y, x, s, h, w = (F.col(n) for n in ("ly", "lx", "level_step", "bh", "bw"))
    two = 2 * s

    def parent(p: Column, side: Column) -> Column:
        up = p.bitwiseAND(F.bitwise_not(two)) + p.bitwiseAND(s)
        return F.when(up >= side, up - two).otherwise(up)

    odd_y, odd_x = y.bitwiseAND(s) != 0, x.bitwiseAND(s) != 0
    right = x.bitwiseOR(s)
    out = [
        _source(parent(y, h), parent(x, w), 2, F.lit(True)),
        _source(y - s, right, 2, odd_y & (right < w)),
        _source(y, x - s, 2, odd_y & odd_x & (right < w)),
    ]
    first = (y >= two) & (x >= two)
    second = first & (y >= 2 * two) & (x >= 2 * two)
    for ring, inside in ((NEAR, first), (FAR, second)):
        out += [_source(y + r * s, x + c * s, k, inside & (x + c * s < w)) for r, c, k in ring]
    return F.filter(F.array(*out), lambda one: one.isNotNull())


def with_sources(coded: DataFrame, spec: Spec) -> DataFrame:
    """One row for each (detail, known neighbour): places of both, and the weight."""
    cells = with_blocks(coded, spec).where("(x | y) > 0").withColumn("side", F.expr(f"shiftleft(level_step, {spec.block_size})"))
    cells = cells.withColumns(
        {
            "oy": F.expr("block_y * side"), "ox": F.expr("block_x * side"), "bh": F.expr(f"least(side, {spec.height} - block_y * side)"),
            "bw": F.expr(f"least(side, {spec.width} - block_x * side)"), "ly": F.expr("y - block_y * side"), "lx": F.expr("x - block_x * side"),
        }
    )
    rows = cells.select(*BLOCK, "y", "x", "oy", "ox", F.explode(_sources(spec)).alias("one"))
    return rows.select(*BLOCK, "y", "x", F.expr("oy + one.sy").alias("sy"), F.expr("ox + one.sx").alias("sx"), F.expr("one.weight").alias("weight"))


def context_moments(coded: DataFrame, spec: Spec) -> DataFrame:
    """image_id, level_step, c, y, x, first, second: 16 times the means of magnitudes and of their squares, rounded."""
    pairs = with_sources(coded, spec)
    values = coded.select("image_id", "c", F.col("y").alias("sy"), F.col("x").alias("sx"), F.abs("v").cast("bigint").alias("size"))
    rows = pairs.join(values, ["image_id", "c", "sy", "sx"])
    capped = F.least(F.col("size"), F.lit(4096))
    sums = rows.groupBy("image_id", "level_step", "c", "y", "x").agg(
        F.sum(F.col("size") * F.col("weight")).bitwiseAND(WORD).alias("total"), F.sum(capped * capped * F.col("weight")).bitwiseAND(WORD).alias("squares"),
        F.sum("weight").alias("n"),
    )
    mean = lambda v: F.expr(f"(({v} * 16 + n div 2) & {WORD}L) div n")
    return sums.select("image_id", "level_step", "c", "y", "x", mean("total").alias("first"), mean("squares").alias("second"))


def code_choices(moments: DataFrame, chroma: bool = False) -> DataFrame:
    """Adds the code each context calls for: ``interleaved`` and ``pot``."""
    base = 250 if chroma else 100
    ladder = (
        (f"2 * second + {base}", None, 0), ("2 * second + 950", None, 1), ("3 * second + 3000", "5 * second + 400", 2),
        ("3 * second + 12000", "5 * second + 3000", 3), ("4 * second + 44000", "6 * second + 12000", 4),
    )
    choice = F.struct(F.lit(False).alias("interleaved"), F.lit(4).alias("pot"))
    for bound, inner, pot in reversed(ladder):
        yes = F.struct(F.lit(True).alias("interleaved"), F.lit(pot).alias("pot"))
        if inner:
            yes = F.when(F.expr(f"total_sq < (({inner}) & {WORD}L)"), F.struct(F.lit(False).alias("interleaved"), F.lit(pot - 1).alias("pot"))).otherwise(yes)
        choice = F.when(F.expr(f"total_sq < (({bound}) & {WORD}L)"), yes).otherwise(choice)
    rows = moments.withColumn("total_sq", F.expr(f"(first * first) & {WORD}L")).withColumn("choice", choice)
    return rows.select(*moments.columns, F.col("choice.interleaved").alias("interleaved"), F.col("choice.pot").alias("pot"))
