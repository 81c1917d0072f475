"""Interleaved bytes, long rows and packed planes, and the ways between them.

* interleaved: ``image_id, pos, sample``: channels of a pixel side by side, layers one after another;
* long: ``image_id, c, y, x, v``;
* packed: ``image_id, c, v ARRAY<INT>`` row by row, what the array kernels take.  An incomplete plane has the cells that
  are there and ``pos``, their places (null for a whole plane), on its way to the kernels, and ``ABSENT`` elsewhere on its way back.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ABSENT
from ..spec import Spec


def clip_byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")  # in this order as in SQL, where it tells for a null


def interleaved_position(spec: Spec) -> Column:
    """Where (c, y, x) lies in the interleaved form; c runs over all layers."""
    n, ch = spec.channel_size, spec.channels
    return F.expr(f"(c div {ch}) * cast({n * ch} as bigint) + c % {ch} + (y * cast({spec.width} as bigint) + x) * {ch}")


def to_interleaved(cells: DataFrame, spec: Spec, value: str = "sample") -> DataFrame:
    return cells.select("image_id", interleaved_position(spec).alias("pos"), F.col(value).alias("sample"))


def to_planar(flat: DataFrame, spec: Spec, boost: int = 1, skip: Collection[int] = ()) -> DataFrame:
    """Long planes of boosted values; skipped channels vanish and later ones move up."""
    n, ch = spec.channel_size, spec.channels
    kept = [c for c in range(ch * spec.layers) if c not in set(skip)]
    rows = flat.withColumn("c", F.expr(f"cast((pos div {n * ch}) * {ch} + pos % {ch} as int)"))
    rows = rows.withColumn("pixel", F.expr(f"(pos % {n * ch}) div {ch}"))
    if len(kept) < ch * spec.layers:
        rows = rows.where(F.col("c").isin(kept))
        gone = sorted(set(skip))
        rows = rows.withColumn("c", F.col("c") - sum((F.when(F.col("c") > g, 1).otherwise(0) for g in gone), F.lit(0)))
    return rows.select(
        "image_id", F.col("c").cast("int").alias("c"), F.expr(f"cast(pixel div {spec.width} as int)").alias("y"),
        F.expr(f"cast(pixel % {spec.width} as int)").alias("x"), (F.col("sample") * boost).cast("int").alias("v"),
    )


def fill_interleaved(base: DataFrame, planes: DataFrame, spec: Spec, boost: int = 1, skip: Collection[int] = ()) -> DataFrame:
    """Writes planes into an interleaved base, which keeps its values in skipped channels."""
    kept = [c for c in range(spec.channels * spec.layers) if c not in set(skip)]
    if not kept:
        return base.select("image_id", "pos", "sample")
    place = F.element_at(F.array(*[F.lit(c) for c in kept]), F.col("c") + 1)
    new = to_interleaved(planes.withColumn("c", place).withColumn("new", clip_byte(F.expr(f"v div {boost}"))), spec, "new")
    new = new.withColumnRenamed("sample", "new")
    return base.join(new, ["image_id", "pos"], "left").select("image_id", "pos", F.coalesce("new", "sample").alias("sample"))


def packed(cells: DataFrame, spec: Spec, value: str = "v") -> DataFrame:
    """One row per plane: the only shuffle of the array path."""
    pos = F.expr(f"y * cast({spec.width} as bigint) + x")
    rows = cells.groupBy("image_id", "c").agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col(value).alias("v")))).alias("cells"))
    n = spec.channel_size
    whole = (F.size("cells") == n) & (F.element_at("cells", -1)["pos"] == n - 1)
    return rows.select("image_id", "c", F.col("cells.v").alias("v"), F.when(~whole, F.col("cells.pos")).alias("pos"))


def unpacked(planes: DataFrame, width: int, value: str = "v") -> DataFrame:
    cells = planes.select("image_id", "c", F.posexplode("v").alias("pos", value)).where(~F.col(value).eqNullSafe(ABSENT))
    return cells.select("image_id", "c", F.expr(f"cast(pos div {width} as int)").alias("y"), F.expr(f"cast(pos % {width} as int)").alias("x"), value)


def lines(cells: DataFrame, value: str = "v") -> DataFrame:
    """The rows of each plane as arrays."""
    rows = cells.groupBy("image_id", "c", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("cells"))
    return rows.select("image_id", "c", "y", F.col("cells.v").alias("line"))
