"""Containers at rest: whole files, and a block table partitioned by level.

``write_blocks`` lays blocks out by ``level_step``, so a downsampled read prunes
the partitions of finer levels before a byte of them is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import CODED


def write_blocks(coded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    coded.repartition("level_step", F.pmod(F.hash("image_id"), F.lit(64))).write.mode(mode).partitionBy("level_step").parquet(path)


def read_blocks(spark: SparkSession, path: str, downsampling: int = 0) -> DataFrame:
    rows = spark.read.schema(CODED).parquet(path)
    return rows.where(F.col("level_step") >= (1 << downsampling)).select(*[f.split()[0] for f in CODED.split(", ")])


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Container files as rows: path, image_id (a hash of the path), bytes."""
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select("path", F.xxhash64("path").alias("image_id"), F.col("content").alias("bytes"))
