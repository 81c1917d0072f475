"""Registered queries of the raster operators; ``oracles`` states each in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .operators import channels, codec, codes, compare, context, headers, lattice, layout, lifting, progressive, quant, turbo
from .plans import lossy
from .sources import rasters
from .spec import Program, Spec

EV = Spec(40, 25, block_size=3, encoder="turbo")
EV_LOSSY = EV.with_(quality=124)
EMB = Spec(64, 20, filter="cubic", block_size=3)
ORD = Spec(50, 30, 3, chroma_scale=8, block_size=4, intent="rgb")
ORD_LOSSY = ORD.with_(quality=124)
PREFIXES = (3, 40, 100, 200, 400, 100_000)


def _v(cells: DataFrame) -> DataFrame:
    return cells.withColumnRenamed("sample", "v")


def interleave_orders(spark, d):
    return layout.to_interleaved(rasters.orders(spark, d), ORD)


def deinterleave_skip(spark, d):
    return layout.to_planar(layout.to_interleaved(rasters.orders(spark, d), ORD), ORD, boost=8, skip={1})


def fill_skipped(spark, d):
    base = layout.to_interleaved(rasters.orders(spark, d), ORD)
    planes = layout.to_planar(base, ORD, boost=8, skip={1}).withColumn("v", F.col("v") + 80)
    return layout.fill_interleaved(base, planes, ORD, boost=8, skip={1})


def plane_lines(spark, d):
    """Lines of each plane, as text to compare."""
    rows = layout.lines(rasters.events(spark, d), "sample")
    return rows.select("image_id", "c", "y", F.expr("array_join(line, ',')").alias("line"))


def _mixed(spark, d, program: Program) -> DataFrame:
    return channels.to_long(channels.mix_forward(rasters.order_pixels(spark, d), program, 3, 8), 3)


def color_roundtrip(spark, d):
    mixed = channels.mix_forward(rasters.order_pixels(spark, d), Program.a710_rgb(), 3, 8)
    return channels.to_long(channels.mix_back(mixed, Program.a710_rgb(), 3, 8), 3, "raw", "sample")


def chroma_flags(spark, d):
    """Which channels of each preset are chroma."""
    presets = {"yuv444": Program.yuv444(), "uyv": Program.uyv(), "a710_bgr": Program.a710_bgr(), "a710_rgb": Program.a710_rgb()}
    rows = [(name, c, flag) for name, p in presets.items() for c, flag in enumerate(p.chroma_flags(3))]
    return spark.createDataFrame(rows, "preset string, c int, is_chroma boolean")


def lattice_histogram(spark, d):
    return rasters.orders(spark, d).groupBy("c", lattice.level_step().alias("level_step")).agg(F.count("*").alias("cells"))


def block_grid(spark, d):
    rows = lattice.with_blocks(rasters.orders(spark, d), ORD)
    return rows.groupBy("level_step", "c", "block_y", "block_x", "block_index").agg(F.count("*").alias("cells"), F.sum("sample").alias("total"))


def block_count(spark, d):
    rows = lattice.block_origins(rasters.orders(spark, d), ORD)
    return rows.groupBy("image_id", "level_step").agg(F.count("*").alias("blocks"))


def _lift_l1(spark, d, kind: str) -> DataFrame:
    return lifting.lift_windows(_v(rasters.events(spark, d)), EV.with_(filter=kind), levels=1)


def _lift_full(spark, d, kind: str, by_place: bool = False) -> DataFrame:
    return lifting.lift(_v(rasters.embeddings(spark, d)), EMB.with_(filter=kind), by_place=by_place)


def _unlift(spark, d, kind: str) -> DataFrame:
    return lifting.unlift(_lift_full(spark, d, kind, True), EMB.with_(filter=kind), by_place=True).withColumnRenamed("v", "sample")


def unlift_windows_l1(spark, d):
    lifted = _lift_l1(spark, d, "cubic")
    return lifting.unlift_windows(lifted, EV.with_(filter="cubic"), levels=1).withColumnRenamed("v", "sample")


def text_lift_l1(spark, d):
    """One level of lifting of each text's bytes, as images of one row: sums per text."""
    rows = lifting.lift_line_sums(rasters.text_lines(spark, d))
    return rows.groupBy("image_id").agg(*[F.sum(n).alias(n) for n in ("n", "total", "weighted")])


def quantize_q124(spark, d):
    lifted = lifting.lift(lossy.boosted(rasters.orders(spark, d), ORD_LOSSY), ORD_LOSSY)
    return quant.quantize(lifted, ORD_LOSSY, chroma=[0, 2])


def dequantize_q124(spark, d):
    return quant.dequantize(quantize_q124(spark, d), ORD_LOSSY, chroma=[0, 2])


def lossy_error_stats(spark, d):
    cells = rasters.events(spark, d)
    return compare.errors(cells, lossy.lossy(cells, EV_LOSSY))


def subband_rate(spark, d):
    return lossy.subband_rate(lossy.coded_planes(rasters.events(spark, d), EV_LOSSY))


def golomb_bits(spark, d):
    """All three codes of every event sample, minus 100 where the sign matters."""
    rows = rasters.events(spark, d).withColumn("s", F.col("sample") - 100)
    texts = {"unsigned_pot0": codes.unsigned_code("sample", 0), "interleaved_pot2": codes.interleaved_code("s", 2), "signed_pot4": codes.signed_code("s", 4)}
    return rows.select("image_id", "y", "x", *[F.expr(t).alias(n) for n, t in texts.items()])


def turbo_runs(spark, d):
    rows = turbo.value_runs(lossy.coded_planes(rasters.events(spark, d), EV_LOSSY), EV_LOSSY)
    return rows.select("image_id", "level_step", "block_y", "block_x", "y", "x", "v", "run")


def _words(spark, d) -> DataFrame:
    return turbo.block_words(lossy.coded_planes(rasters.events(spark, d), EV_LOSSY), EV_LOSSY)


def turbo_level_table(spark, d):
    return _words(spark, d).groupBy("image_id", "level_step").agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words"))


def _indexed_words(spark, d) -> DataFrame:
    nx = F.expr(f"cast(({EV.width} + shiftleft(level_step, {EV.block_size}) - 1) div shiftleft(level_step, {EV.block_size}) as int)")
    return _words(spark, d).withColumn("block_index", F.col("block_y") * nx + F.col("block_x"))


def block_offsets(spark, d):
    rows = progressive.block_offsets(_indexed_words(spark, d), EV_LOSSY)
    return rows.select("image_id", "level_step", "block_index", "n_words", "at")


def point_of_interest(spark, d):
    return progressive.points_of_interest(_words(spark, d), EV_LOSSY, PREFIXES)


def _specs(spark, d) -> DataFrame:
    """Specifications of all kinds, from order keys."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return rows.selectExpr(
        "o_orderkey as image_id", "1 as version", "cast(o_orderkey % 4001 as int) as width", "cast(1 + o_orderkey % 701 as int) as height",
        "cast(1 + o_orderkey % 4 as int) as channels", "cast(1 + o_orderkey % 3 as int) as layers", "cast(o_orderkey % 1025 as int) as quality",
        "cast(1 + o_orderkey % 255 as int) as chroma_scale", "cast(1 + o_orderkey % 30 as int) as block_size",
        "element_at(array('linear', 'cubic'), cast(1 + o_orderkey % 2 as int)) as filter",
        "element_at(array('turbo', 'fast', 'contextual'), cast(1 + o_orderkey % 3 as int)) as encoder",
        "element_at(array('generic', 'rgb', 'rgba', 'bgr', 'bgra', 'yuv444'), cast(1 + o_orderkey % 6 as int)) as intent",
        "cast(4 * (o_orderkey % 5) as int) as metadata_size",
    )


def header_checks(spark, d):
    return headers.checked(_specs(spark, d)).select("image_id", "status")


def header_sizes(spark, d):
    names = ("channel_size", "image_size", "boost", "chroma_quality", "small_width", "small_height", "decoded_size")
    good = headers.checked(_specs(spark, d)).where("status = 'ok'")
    return headers.sizes(good, 2).select("image_id", *names)


def header_hex(spark, d):
    good = headers.checked(_specs(spark, d)).where("status = 'ok'")
    return headers.header_hex(good).select("image_id", "header")


def header_fields(spark, d):
    """Headers written and read again: the fields of the specifications."""
    rows = headers.parse_headers(header_hex(spark, d))
    ints = [F.col(n).cast("int").alias(n) for n in ("width", "height", "channels", "layers", "quality", "chroma_scale", "block_size", "metadata_size")]
    return rows.select("image_id", *ints, "filter", "encoder", "intent", "status")


def context_moments(spark, d):
    return context.context_moments(lossy.coded_planes(rasters.events(spark, d), EV_LOSSY), EV_LOSSY)


def code_choices(spark, d):
    return context.code_choices(context_moments(spark, d)).select("image_id", "y", "x", F.col("interleaved").cast("int").alias("interleaved"), "pot")


def _roundtrip(spark, d, encoder: str) -> DataFrame:
    program = Program.uyv() if encoder != "turbo" else Program.a710_bgr()
    return lossy.round_trip(rasters.orders(spark, d), ORD.with_(encoder=encoder, chroma_scale=1, filter="cubic"), program)


def roundtrip_blocks(spark, d):
    """Coded blocks as rows and back, without containers."""
    spec = EMB.with_(encoder="fast")
    back = codec.decode_blocks(codec.encode_blocks(_v(rasters.embeddings(spark, d)), spec), spec)
    return back.withColumnRenamed("v", "sample")


def _downsample(spark, d, n: int) -> DataFrame:
    return lossy.round_trip(rasters.embeddings(spark, d), EMB.with_(filter="linear"), downsampling=n)


def container_status(spark, d):
    """Complete containers need no more data, and every one can be read."""
    made = codec.encode_rasters(rasters.events(spark, d), EV)
    return codec.check_containers(made)


def compare_equal(spark, d):
    """Events against a copy in which every sample of 200 or more is changed."""
    a = rasters.events(spark, d)
    b = a.withColumn("sample", F.when(F.col("sample") >= 200, F.col("sample") - 1).otherwise(F.col("sample")))
    return compare.differences(a, b)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        interleave_orders, deinterleave_skip, fill_skipped, plane_lines, color_roundtrip, chroma_flags, lattice_histogram, block_grid,
        block_count, unlift_windows_l1, text_lift_l1, quantize_q124, dequantize_q124, lossy_error_stats, subband_rate, golomb_bits, turbo_runs,
        turbo_level_table, block_offsets, point_of_interest, header_checks, header_sizes, header_hex, header_fields, context_moments,
        code_choices, roundtrip_blocks, container_status, compare_equal,
    )
    found = {f.__name__: f for f in own}
    found |= {"raster_events": rasters.events, "raster_embeddings": rasters.embeddings, "raster_orders": rasters.orders}
    for name, program in (("uyv", Program.uyv()), ("a710_bgr", Program.a710_bgr()), ("a710_rgb", Program.a710_rgb())):
        found[f"color_{name}"] = lambda spark, d, p=program: _mixed(spark, d, p)
    for kind in ("linear", "cubic"):
        found[f"lift_{kind}_l1"] = lambda spark, d, k=kind: _lift_l1(spark, d, k)
        found[f"lift_{kind}_full"] = lambda spark, d, k=kind: _lift_full(spark, d, k)
        found[f"unlift_{kind}_roundtrip"] = lambda spark, d, k=kind: _unlift(spark, d, k)
    found["turbo_block_hex"] = lambda spark, d: _words(spark, d).select("image_id", "level_step", "block_y", "block_x", "words", "n_words")
    for encoder in ("turbo", "fast", "contextual"):
        found[f"roundtrip_{encoder}"] = lambda spark, d, e=encoder: _roundtrip(spark, d, e)
    for n in (1, 2):
        found[f"downsample_{n}"] = lambda spark, d, k=n: _downsample(spark, d, k)
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.statements()
