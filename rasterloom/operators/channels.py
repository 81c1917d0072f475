"""Channel programs as chains of columns: Catalyst merges a chain into one Project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Mix, Program
from .layout import clip_byte


def _term(mix: Mix, prefix: str, floor: bool) -> Column:
    total = " + ".join(f"({f}) * {prefix}{src}" for src, f in mix.factors) or "0"
    if floor and mix.denom in (2, 4, 8):  # shifts round down, which some decoders do for these three
        return F.expr(f"shiftright(cast({total} as int), {mix.denom.bit_length() - 1})")
    return F.expr(f"cast(({total}) div {mix.denom} as int)")


def mix_forward(pixels: DataFrame, program: Program, channels: int, boost: int, floor_div: bool = False) -> DataFrame:
    """Columns ``raw0..`` to ``ch0..``: boosted, then mixed in the program's order."""
    program.chroma_flags(channels)
    out = pixels.withColumns({f"ch{k}": (F.col(f"raw{k}") * boost).cast("int") for k in range(channels)})
    for m in program:
        if m.mixes:
            out = out.withColumn(f"ch{m.dest}", F.col(f"ch{m.dest}") + _term(m, "ch", floor_div))
    return out.drop(*(f"raw{k}" for k in range(channels)))


def mix_back(pixels: DataFrame, program: Program, channels: int, boost: int, floor_div: bool = False) -> DataFrame:
    """The inverse: columns ``ch0..`` to bytes ``raw0..``."""
    out = pixels
    for m in reversed(program.mixes):
        if m.mixes:
            out = out.withColumn(f"ch{m.dest}", F.col(f"ch{m.dest}") - _term(m, "ch", floor_div))
    out = out.withColumns({f"raw{k}": clip_byte(F.expr(f"ch{k} div {boost}")) for k in range(channels)})
    return out.drop(*(f"ch{k}" for k in range(channels)))


def to_long(pixels: DataFrame, channels: int, prefix: str = "ch", value: str = "v") -> DataFrame:
    pairs = ", ".join(f"{k}, {prefix}{k}" for k in range(channels))
    return pixels.selectExpr("image_id", f"stack({channels}, {pairs}) as (c, {value})", "y", "x").select("image_id", "c", "y", "x", value)


def to_wide(cells: DataFrame, channels: int, prefix: str = "raw", value: str = "sample") -> DataFrame:
    """One shuffle on the pixel; every channel becomes a column."""
    own = [F.max(F.when(F.col("c") == k, F.col(value))).alias(f"{prefix}{k}") for k in range(channels)]
    return cells.groupBy("image_id", "y", "x").agg(*own)
