"""Equality and error of rasters by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "c", "y", "x"]


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(*KEY, F.col("sample").alias("a"))
    b = right.select(*KEY, F.col("sample").alias("b"))
    return a.join(b, KEY, "full_outer")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per image: how many samples differ or exist on one side only; 0 rows of difference mean equal."""
    rows = _joined(left, right).groupBy("image_id").agg(F.count("*").alias("samples"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("different"))
    return rows.withColumn("equal", F.col("different") == 0)


def errors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per image and channel: samples, greatest absolute error, sums of absolute and squared errors."""
    off = F.abs(F.col("a") - F.col("b")).cast("bigint")
    rows = _joined(left, right).select("image_id", "c", off.alias("off"))
    return rows.groupBy("image_id", "c").agg(
        F.count("*").alias("samples"), F.max("off").alias("max_error"), F.sum("off").alias("sum_error"), F.sum(F.col("off") * F.col("off")).alias("sum_squares")
    )
