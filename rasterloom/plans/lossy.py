"""Plans of several operators: what a lossy or lossless coding of a raster does to its samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import container
from ..functions import kernels
from ..operators import codec, lattice
from ..operators.codes import interleaved_code
from ..operators.layout import clip_byte, packed, unpacked
from ..operators.lifting import over_planes
from ..spec import Program, Spec


def boosted(cells: DataFrame, spec: Spec) -> DataFrame:
    return cells.select("image_id", "c", "y", "x", (F.col("sample") * spec.boost).cast("int").alias("v"))


def coded_planes(cells: DataFrame, spec: Spec, chroma: list[bool] | None = None) -> DataFrame:
    """Samples to quantised details (long, ``v``): one shuffle, one pass over Arrow batches."""
    flags = chroma or [False] * (spec.channels * spec.layers)
    return unpacked(codec.transform_planes(boosted(cells, spec), spec, flags), spec.width)


def lossy(cells: DataFrame, spec: Spec, chroma: list[bool] | None = None) -> DataFrame:
    """Samples as they come back from coding, without the coding."""
    flags = chroma or [False] * (spec.channels * spec.layers)

    def there_and_back(plane, c):
        return container.untransform_plane(spec, container.transform_plane(spec, plane, flags[c]), flags[c])

    back = unpacked(over_planes(packed(boosted(cells, spec), spec), spec.height, spec.width, there_and_back), spec.width)
    return back.select("image_id", "c", "y", "x", clip_byte(F.expr(f"v div {spec.boost}")).alias("sample"))


def round_trip(cells: DataFrame, spec: Spec, program: Program | None = None, downsampling: int = 0) -> DataFrame:
    """Samples through a whole container and back."""
    return codec.decoded_cells(codec.decode_rasters(codec.encode_rasters(cells, spec, program), downsampling))


def low_pass(cells: DataFrame, spec: Spec, d: int) -> DataFrame:
    """What a lossless downsampled read returns, computed by lifting ``d`` levels."""
    kind = spec.filter
    part = over_planes(packed(boosted(cells, spec), spec), spec.height, spec.width, lambda p, c: kernels.lift(p, kind, d))
    small = unpacked(part, spec.width).where(f"x % {1 << d} = 0 and y % {1 << d} = 0")
    return small.selectExpr("image_id", "c", f"cast(y div {1 << d} as int) as y", f"cast(x div {1 << d} as int) as x", "v")


def subband_rate(coded: DataFrame) -> DataFrame:
    """Per channel and level: cells, non-zero details and the bits that the simplest code would take."""
    bits = F.length(F.expr(interleaved_code("v", 1)))
    rows = coded.select("c", lattice.level_step().alias("level_step"), "v", bits.alias("bits"))
    return rows.groupBy("c", "level_step").agg(
        F.count("*").alias("cells"), F.count(F.when(F.col("v") != 0, 1)).alias("nonzero"), F.sum("bits").cast("bigint").alias("bits")
    )
