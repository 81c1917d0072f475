"""Rasters made from the supplied tables: long form ``image_id, c, y, x, sample``, one row per sample.

Each is one ``Project`` over a scan (``orders`` joins a pre-aggregated
``lineitem``), so column pruning and filters reach the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    width: int
    height: int
    channels: int = 1


EVENTS = Shape(40, 25)
EMBEDDINGS = Shape(64, 20)
ORDERS = Shape(50, 30, 3)


def _int(expr: str, name: str):
    return F.expr(f"cast({expr} as int)").alias(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand events are an image of 40 x 25 values, clipped at 255."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.expr("event_id div 1000").alias("image_id"), _int("0", "c"), _int("(event_id % 1000) div 40", "y"),
        _int("event_id % 40", "x"), _int("least(255, floor(value))", "sample"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty vectors of 64 numbers are the rows of an image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = rows.select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return cells.select(
        F.expr("vec_id div 20").alias("image_id"), _int("0", "c"), _int("vec_id % 20", "y"), "x",
        _int("floor((cast(e as double) + 1) * 127.5)", "sample"),
    )


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a pixel of an image of 50 x 30; price, quantity and lines are its channels ``raw0..raw2``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return rows.select(
        F.expr("o_orderkey div 1500").alias("image_id"), _int("(o_orderkey % 1500) div 50", "y"), _int("o_orderkey % 50", "x"),
        _int("least(255, floor(o_totalprice / 2000))", "raw0"), _int("least(255, coalesce(quantity, 0))", "raw1"),
        _int("least(255, 15 * coalesce(n, 0))", "raw2"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pixels(spark, sf_dir).selectExpr("image_id", "stack(3, 0, raw0, 1, raw1, 2, raw2) as (c, sample)", "y", "x").select("image_id", "c", "y", "x", "sample")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's UTF-8 bytes are an image of one row, not yet a row for each sample: ``image_id, data``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.col("doc_id").cast("bigint").alias("image_id"), F.encode("text", "UTF-8").alias("data"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form; lengths differ."""
    pairs = text_lines(spark, sf_dir).select("image_id", F.posexplode(F.expr("regexp_extract_all(hex(data), '..', 0)")).alias("x", "two"))
    return pairs.select("image_id", _int("0", "c"), _int("0", "y"), "x", _int("conv(two, 16, 10)", "sample"))
