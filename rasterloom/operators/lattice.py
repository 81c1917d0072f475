"""Levels and blocks as expressions of a cell's place.

A cell's level is the lowest set bit of ``x | y``: the step of the lattice at
which lifting last made it a detail.  Cell (0, 0) has level 0.  A block of a
level has ``step << block_size`` cells a side, numbered channel first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Spec

IMAGE = ("image_id", "c")
BLOCK = ("image_id", "level_step", "c", "block_y", "block_x")


def level_step(y: str = "y", x: str = "x") -> Column:
    return F.expr(f"cast(({x} | {y}) & -({x} | {y}) as int)")


def with_blocks(cells: DataFrame, spec: Spec) -> DataFrame:
    """Adds level_step, block_y, block_x and block_index; the origin's own row joins the coarsest level."""
    top = spec.steps()[0]
    side = F.shiftleft(F.col("level_step"), spec.block_size) if spec.block_size + top.bit_length() < 31 else F.lit(1 << 30)
    out = cells.withColumn("level_step", F.when(F.expr("(x | y) = 0"), top).otherwise(level_step()))
    out = out.withColumn("side", side)
    out = out.withColumn("block_y", F.expr("cast(y div side as int)")).withColumn("block_x", F.expr("cast(x div side as int)"))
    ny, nx = (F.expr(f"cast(({n} + side - 1) div side as int)") for n in (spec.height, spec.width))
    return out.withColumn("block_index", (F.col("c") * ny + F.col("block_y")) * nx + F.col("block_x")).drop("side")


def block_origins(cells: DataFrame, spec: Spec) -> DataFrame:
    """One row for each block of each level, also of blocks that hold no cell of their level."""
    rows = [F.struct(F.lit(s).alias("level_step"), F.lit(min(s << spec.block_size, 1 << 30)).alias("side")) for s in spec.steps()]
    out = cells.select(*IMAGE, "y", "x", F.explode(F.array(*rows)).alias("level"))
    out = out.where("y % level.side = 0 and x % level.side = 0")
    return out.selectExpr("image_id", "level.level_step", "c", "cast(y div level.side as int) as block_y", "cast(x div level.side as int) as block_x")


def level_table(spec: Spec):
    """(step, blocks down, blocks across) from the coarsest level to the finest: what plans and pruned reads need."""
    return [(s, spec.block_grid(s)[1], spec.block_grid(s)[0]) for s in spec.steps()]
