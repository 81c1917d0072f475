"""Where reading stops and goes on: prefixes of containers, planned from block sizes alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Spec


def level_sizes(words: DataFrame, spec: Spec) -> DataFrame:
    """One row per image and level: blocks, coded bytes, and where its size table starts in the payload."""
    rows = words.groupBy("image_id", "level_step").agg(F.count("*").alias("blocks"), (4 * F.sum("n_words")).cast("bigint").alias("coded"))
    before = Window.partitionBy("image_id").orderBy(F.desc("level_step")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(4 * F.col("blocks") + F.col("coded")).over(before), F.lit(0)).cast("bigint"))


def block_offsets(words: DataFrame, spec: Spec) -> DataFrame:
    """Adds ``at``, the offset of each block in its payload: what a ranged read needs."""
    levels = level_sizes(words, spec).select("image_id", "level_step", (F.col("start") + 4 * F.col("blocks")).alias("first"))
    before = Window.partitionBy("image_id", "level_step").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = words.withColumn("skipped", F.coalesce(F.sum(4 * F.col("n_words")).over(before), F.lit(0)))
    return rows.join(levels, ["image_id", "level_step"]).withColumn("at", (F.col("first") + F.col("skipped")).cast("bigint")).drop("first", "skipped")


def points_of_interest(words: DataFrame, spec: Spec, prefixes: Sequence[int], downsampling: int = 0) -> DataFrame:
    """For prefixes of so many payload bytes: image_id, prefix, point_of_interest (0: all there), status.

    A level whose size table is cut stops the walk; a coarser level cut within its blocks is an error.
    """
    least = 1 << downsampling
    levels = level_sizes(words, spec).where(F.col("level_step") >= least)
    levels = levels.withColumn("prefix", F.explode(F.array(*[F.lit(n) for n in prefixes])))
    finer = F.when(F.col("level_step") > least, 16 * F.col("blocks")).otherwise(0)
    rows = levels.withColumns(
        {
            "met": F.expr("prefix - start > 4 * blocks"), "stop": F.expr("start + 4 * blocks + coded"), "late": F.expr("start > prefix"),
        }
    ).withColumn("target", F.col("stop") + finer)
    ends = rows.groupBy("image_id", "prefix").agg(
        F.min_by("target", F.when(F.col("met"), F.col("level_step"))).alias("target"),
        F.bool_or(~F.col("met") | F.expr("stop > prefix")).alias("cut"),
        F.coalesce(F.max_by("late", F.when(~F.col("met"), F.col("level_step"))), F.lit(False)).alias("late"),
    )
    wanted = F.when(~F.col("cut"), 0).otherwise(F.coalesce("target", F.col("prefix") + 1024))
    status = F.when(F.col("late"), "underflow").otherwise("ok")
    return ends.select("image_id", "prefix", F.when(~F.col("late"), wanted).cast("bigint").alias("point_of_interest"), status.alias("status"))
