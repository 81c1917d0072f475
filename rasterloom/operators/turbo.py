"""The turbo coder of whole planes without Python: runs are gaps between non-zero values.

Every block's bits come from one window (the place of a value in its block) and
one grouped concatenation in scan order.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import turbo_runs
from ..spec import Spec
from .codes import signed_code, unsigned_code, words_hex
from .lattice import BLOCK, block_origins, with_blocks


def _has_runs(spec: Spec, chroma: Collection[int]):
    """Whether a level of a channel is coded with runs of zeros."""
    def steps(q: int) -> list[int]:
        return [s for s in spec.steps() if turbo_runs(q, s)]

    own = F.col("level_step").isin(steps(spec.quality))
    if chroma:
        return F.when(F.col("c").isin(list(chroma)), F.col("level_step").isin(steps(spec.chroma_quality))).otherwise(own)
    return own


def value_runs(coded: DataFrame, spec: Spec) -> DataFrame:
    """Non-zero values of each block with the zeros before them: image_id, level_step, c, block_y, block_x, y, x, v, n, run."""
    cells = with_blocks(coded, spec).where("(x | y) > 0")
    scan = Window.partitionBy(*BLOCK).orderBy("y", "x")
    placed = cells.withColumn("n", F.row_number().over(scan)).where("v != 0")
    run = F.expr("n - coalesce(lag(n) over (partition by {0} order by y, x), 0) - 1".format(", ".join(BLOCK)))
    return placed.withColumn("run", run.cast("int")).select(*BLOCK, "y", "x", "v", "n", "run")


def block_bits(coded: DataFrame, spec: Spec, chroma: Collection[int] = ()) -> DataFrame:
    """One row per block: its bits as text, in the order of the container."""
    cells = with_blocks(coded, spec).drop("block_index")
    scan = Window.partitionBy(*BLOCK).orderBy("y", "x")
    origin = F.expr("(x | y) = 0")
    cells = cells.withColumn("origin", origin).withColumn("n", F.sum(F.when(origin, 0).otherwise(1)).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("runs", _has_runs(spec, chroma))
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.when((F.col("v") != 0) & ~F.col("origin"), F.col("n"))).over(before), F.lit(0))
    cells = cells.withColumn("run", (F.col("n") - last - 1).cast("int"))
    # One code text for both modes: with runs a negative value is moved up by one first.
    moved = F.when(F.col("runs") & (F.col("v") < 0), F.col("v") + 1).otherwise(F.col("v"))
    cells = cells.withColumn("s", F.when(moved > 0, 2 * moved - 1).otherwise(-2 * moved).cast("int"))
    own = F.expr(unsigned_code("s", 1))
    code = F.when(F.col("origin"), F.expr(signed_code("v", 4)))
    code = code.when(~F.col("runs"), own).when(F.col("v") == 0, "").otherwise(F.concat(F.expr(unsigned_code("run", 1)), own))
    rows = cells.select(*BLOCK, "y", "x", code.alias("code"), "runs", "n", (F.col("v") != 0).alias("some"), "origin")
    empty = block_origins(coded, spec).selectExpr(*BLOCK, "-1 as y", "-1 as x", "'' as code", "false as runs", "0L as n", "false as some", "false as origin")
    every = rows.unionByName(empty)
    grouped = every.groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("y", "x", "code"))).alias("codes"), F.max("runs").alias("runs"), F.max("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("some") & ~F.col("origin"), F.col("n"))), F.lit(0)).alias("last"),
    )
    tail = F.when(F.col("runs") & (F.col("n") > F.col("last")), F.expr(unsigned_code("cast(n - last as int)", 1))).otherwise("")
    return grouped.select(*BLOCK, F.concat(F.expr("array_join(codes.code, '')"), tail).alias("bits"))


def block_words(coded: DataFrame, spec: Spec, chroma: Collection[int] = ()) -> DataFrame:
    """One row per block: its words as hex, and how many they are."""
    rows = block_bits(coded, spec, chroma)
    return rows.select(*BLOCK, F.expr(words_hex("bits")).alias("words"), F.expr("cast((length(bits) + 31) div 32 as int)").alias("n_words"))
