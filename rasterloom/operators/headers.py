"""Header bytes as expressions over a table of specifications, one row for each image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ENCODERS, FILTERS, INTENTS, MAGIC, QUANTIZATIONS
from .codes import little_endian, read_little_endian

FIELDS = ("version", "width", "height", "channels", "layers", "quality", "chroma_scale", "block_size", "filter", "encoder", "intent", "metadata_size")
LIMITS = {"width": (0, 1 << 30), "height": (0, 1 << 30), "quality": (0, 1025), "chroma_scale": (0, 256), "block_size": (1, 31), "channels": (0, 65_537), "layers": (0, 65_537)}


def check_range(name: str, low: int, high: int) -> str:
    """SQL text: inside, both ends excluded."""
    return f"({low} < {name} and {name} < {high})"


def checked(specs: DataFrame) -> DataFrame:
    """Adds ``status``: ok, or the first field that is out of its range."""
    status = F.lit("ok")
    for name, (low, high) in reversed(LIMITS.items()):
        status = F.when(F.expr(check_range(name, low, high)), status).otherwise(name)
    return specs.withColumn("status", status)


def sizes(specs: DataFrame, downsampling: int = 0) -> DataFrame:
    """Sizes and derived numbers: channel_size, image_size, boost, chroma_quality, and the downsampled sides and size."""
    scale = 1 << downsampling
    out = specs.withColumns(
        {
            "channel_size": F.expr("cast(width as bigint) * height"),
            "boost": F.when(F.col("quality") == 1024, 1).otherwise(8),
            "chroma_quality": F.expr("cast(greatest(1, (quality + chroma_scale div 2) div chroma_scale) as int)"),
            "small_width": F.expr(f"cast((width + {scale - 1}) div {scale} as int)"),
            "small_height": F.expr(f"cast((height + {scale - 1}) div {scale} as int)"),
        }
    )
    return out.withColumns(
        {"image_size": F.expr("channel_size * channels * layers"), "decoded_size": F.expr("cast(small_width as bigint) * small_height * channels * layers")}
    )


def _code(table: dict[str, int], name: str) -> str:
    return f"case {name} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " end"


def header_hex(specs: DataFrame) -> DataFrame:
    """Adds ``header``: the 32 bytes in hex."""
    packed = "(block_size - 2) | shiftleft(chroma_scale - 1, 5) | shiftleft(quality - 1, 13)"
    parts = [
        little_endian(str(MAGIC), 4), little_endian("version", 4), little_endian("width", 4), little_endian("height", 4),
        little_endian("channels - 1", 2), little_endian("layers - 1", 2), little_endian(packed, 3), "'07'",
        little_endian(_code(INTENTS, "intent"), 1), little_endian(_code(ENCODERS, "encoder"), 1), "'00'",
        little_endian(_code(FILTERS, "filter"), 1), little_endian("metadata_size div 4", 4),
    ]
    return specs.withColumn("header", F.expr(f"concat({', '.join(parts)})"))


def _label(table: dict[str, int], code: str) -> str:
    return f"case {code} " + " ".join(f"when {v} then '{k}'" for k, v in table.items()) + " end"


def parse_headers(rows: DataFrame, header: str = "header") -> DataFrame:
    """The fields of a column of hex headers, with ``status``: ok, or why it can't be read."""
    at = lambda k, n: read_little_endian(header, k, n)
    packed = "_packed"
    out = rows.withColumn(packed, F.expr(at(20, 3))).withColumns(
        {
            "version": F.expr(at(4, 4)), "width": F.expr(at(8, 4)), "height": F.expr(at(12, 4)),
            "channels": F.expr(f"{at(16, 2)} + 1"), "layers": F.expr(f"{at(18, 2)} + 1"),
            "quality": F.expr(f"(shiftright({packed}, 13) & 1023) + 1"), "chroma_scale": F.expr(f"(shiftright({packed}, 5) & 255) + 1"),
            "block_size": F.expr(f"({packed} & 31) + 2"), "is_signed": F.expr(f"(shiftright({packed}, 23) & 1) = 1"),
            "bit_depth": F.expr(f"{at(23, 1)} + 1"), "intent": F.expr(_label(INTENTS, at(24, 1))), "encoder": F.expr(_label(ENCODERS, at(25, 1))),
            "quantization": F.expr(_label(QUANTIZATIONS, at(26, 1))), "filter": F.expr(_label(FILTERS, at(27, 1))),
            "metadata_size": F.expr(f"4 * {at(28, 4)}"),
        }
    )
    known = F.expr("intent is not null and encoder is not null and quantization is not null and filter is not null")
    status = F.when(F.length(header) < 64, "short").when(F.expr(at(0, 4)) != MAGIC, "magic").when(~known, "enumeration")
    status = status.when(F.expr("is_signed or bit_depth != 8"), "samples")
    ranged = F.lit("ok")
    for name, (low, high) in reversed(LIMITS.items()):
        ranged = F.when(F.expr(check_range(name, low, high)), ranged).otherwise(name)
    return out.withColumn("status", status.otherwise(ranged)).drop(packed)
