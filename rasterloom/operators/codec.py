"""Whole containers and single blocks over many images.

Images are independent, and so are the blocks of an image when encoding: blocks
of all levels are coded as rows.  Decoding of the turbo and fast schemes is also
by block; the contextual scheme needs the coarser levels of its plane first, so
its unit is the image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RasterError, UnderflowError
from ..functions import blocks, container, kernels
from ..spec import Program, Spec
from .layout import packed, unpacked

CODED = "image_id bigint, level_step int, c int, block_y int, block_x int, block_index int, n_words int, bytes binary, present binary"


def _bits(there: np.ndarray) -> bytes | None:
    """Which cells are there, one bit each; null if all are."""
    return None if there.all() else np.packbits(there).tobytes()


def _there(present: bytes, shape: tuple[int, ...], d: int = 0) -> np.ndarray:
    """The bits of a whole plane or image again, as far as ``d`` keeps them."""
    flags = np.unpackbits(np.frombuffer(present, np.uint8), count=int(np.prod(shape)))
    return flags.reshape(shape)[..., :: 1 << d, :: 1 << d].astype(bool)


def images(cells: DataFrame, spec: Spec, value: str = "sample") -> DataFrame:
    """One row per image: its planes, in channel order, with their channels and places (see ``layout``)."""
    planes = packed(cells.withColumnRenamed(value, "v") if value != "v" else cells, spec)
    rows = planes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("c", "v", "pos"))).alias("all"))
    return rows.select("image_id", F.col("all.v").alias("planes"), F.col("all.c").alias("cs"), F.col("all.pos").alias("places"))


def _raster(spec: Spec, planes, cs, places) -> tuple[Spec, np.ndarray, bytes | None]:
    """An image's size, bytes (channels, h, w) and the cells that are there; those that aren't repeat the one before."""
    n = spec.channels * spec.layers
    planes = [np.asarray(v) for v in planes]
    if len(planes) == n and all(p is None for p in places) and all(v.dtype.kind == "i" for v in planes):
        return spec, np.stack([v.astype(np.uint8).reshape(spec.height, spec.width) for v in planes]), None
    grid = np.full((n, spec.channel_size), kernels.ABSENT, np.int64)
    for v, c, pos in zip(planes, cs, places):
        known = v == v
        grid[c, (np.arange(len(v)) if pos is None else pos)[known]] = v[known]
    grid = grid.reshape(n, spec.height, spec.width)
    ys, xs = ((grid != kernels.ABSENT).any(axis).nonzero()[0] for axis in ((0, 2), (0, 1)))
    box = grid[:, : ys.max(initial=0) + 1, : xs.max(initial=0) + 1]
    there = box != kernels.ABSENT
    flat = there.reshape(n, -1)
    last = np.maximum.accumulate(np.where(flat, np.arange(flat.shape[1]), flat.argmax(1)[:, None]), axis=1)
    filled = np.maximum(0, np.take_along_axis(box.reshape(n, -1), last, 1)).astype(np.uint8).reshape(box.shape)
    return spec.with_(height=box.shape[1], width=box.shape[2]), filled, _bits(there)


def encode_rasters(cells: DataFrame, spec: Spec, program: Program | None = None, value: str = "sample") -> DataFrame:
    """Long samples to containers: image_id, bytes, present.

    An image that ends before its last row or column is a smaller one; ``present`` tells the cells of one with other
    cells missing, and is null for others.
    """
    program = program or Program()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made, bits = [], []
            for planes, cs, places in zip(rows["planes"], rows["cs"], rows["places"]):
                own, raw, present = _raster(spec, planes, cs, places)
                made.append(container.encode_image(own, program, container.planes_to_interleaved(raw, spec.layers)))
                bits.append(present)
            yield pd.DataFrame({"image_id": rows["image_id"], "bytes": made, "present": bits})

    return images(cells, spec, value).mapInPandas(run, "image_id bigint, bytes binary, present binary")


def decode_rasters(containers: DataFrame, downsampling: int = 0) -> DataFrame:
    """Containers (image_id, bytes, and present if there is such a column) to packed samples.

    Returns image_id, c, v (row by row), width, height, point_of_interest and status (ok, or the error's
    name); a container that can't be read gives one row with null samples, and others go on.
    """

    def one(image_id: int, data: bytes, present: bytes | None) -> list[tuple]:
        try:
            spec, _, _ = container.open_container(data)
            pixels, target = container.decode_image(data, downsampling)
        except RasterError as e:
            return [(image_id, 0, None, None, None, None, type(e).__name__)]
        w, h = spec.downsampled(downsampling)
        flat = np.frombuffer(pixels, np.uint8).reshape(spec.layers, w * h, spec.channels).transpose(0, 2, 1)
        flat = flat.reshape(-1, w * h).astype(np.int32)
        if present is not None:
            there = _there(present, (len(flat), spec.height, spec.width), downsampling)
            flat = np.where(there.reshape(len(flat), -1), flat, np.int32(kernels.ABSENT))
        return [(image_id, c, p, w, h, target, "ok") for c, p in enumerate(flat)]

    names = ["image_id", "c", "v", "width", "height", "point_of_interest", "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for image_id, data, present in zip(rows["image_id"], rows["bytes"], rows["present"]):
                out = pd.DataFrame(one(image_id, bytes(data) if data is not None else b"", present), columns=names)
                for n in ("width", "height", "point_of_interest"):
                    out[n] = out[n].astype("Int64")
                yield out

    present = F.col("present") if "present" in containers.columns else F.lit(None).cast("binary").alias("present")
    return containers.select("image_id", "bytes", present).mapInPandas(run, "image_id bigint, c int, v array<int>, width int, height int, point_of_interest bigint, status string")


def decoded_cells(decoded: DataFrame) -> DataFrame:
    """Packed samples to long ones."""
    rows = decoded.where("status = 'ok'").select("image_id", "c", "width", F.posexplode("v").alias("pos", "sample")).where(F.col("sample") != kernels.ABSENT)
    return rows.selectExpr("image_id", "c", "cast(pos div width as int) as y", "cast(pos % width as int) as x", "sample")


def transform_planes(cells: DataFrame, spec: Spec, chroma: list[bool], by_place: bool = False) -> DataFrame:
    """Boosted planes (long, ``v``) to lifted and quantised ones, packed."""
    from .lifting import over_planes

    return over_planes(packed(cells, spec), spec.height, spec.width, lambda p, c: container.transform_plane(spec, p, chroma[c]), by_place)


def encode_blocks(cells: DataFrame, spec: Spec, chroma: list[bool] | None = None) -> DataFrame:
    """Boosted planes to coded blocks: the table a sink partitions by level.

    ``present`` of an incomplete plane's first block tells which cells are there; it is null elsewhere.
    """
    chroma = chroma or [False] * (spec.channels * spec.layers)
    top = spec.steps()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for image_id, c, v in zip(rows["image_id"], rows["c"], rows["v"]):
                v = np.asarray(v)
                there = (v != kernels.ABSENT) & (v == v)
                present, plane = _bits(there), np.where(there, v, 0).astype(np.int32).reshape(spec.height, spec.width)
                for step in spec.steps():
                    nx, ny = spec.block_grid(step)
                    side = step << spec.block_size
                    for by in range(ny):
                        for bx in range(nx):
                            window = plane[by * side : (by + 1) * side, bx * side : (bx + 1) * side]
                            dc = step == top and not by and not bx
                            data = blocks.encode_block(window, step, spec.encoder, container.quality_of(spec, chroma[c]), dc, chroma[c])
                            made.append((image_id, step, c, by, bx, (c * ny + by) * nx + bx, len(data) // 4, data, present if dc else None))
            yield pd.DataFrame(made, columns=[f.split()[0] for f in CODED.split(", ")])

    return transform_planes(cells, spec, chroma, by_place=True).mapInPandas(run, CODED)


def decode_blocks(coded: DataFrame, spec: Spec, chroma: list[bool] | None = None, downsampling: int = 0) -> DataFrame:
    """Coded blocks back to boosted planes (long, ``v``); a filter on ``level_step`` reaches a sink partitioned by it."""
    chroma = chroma or [False] * (spec.channels * spec.layers)
    d, top = downsampling, spec.steps()[0]
    w, h = spec.downsampled(d)
    needed = coded.where(F.col("level_step") >= (1 << d))

    def plane(rows: pd.DataFrame) -> pd.DataFrame:
        c = int(rows["c"].iloc[0])
        out = np.zeros((h, w), np.int32)
        for r in rows.sort_values(["level_step", "block_index"], ascending=[False, True]).itertuples():
            side = (r.level_step >> d) << spec.block_size
            window = out[r.block_y * side : (r.block_y + 1) * side, r.block_x * side : (r.block_x + 1) * side]
            dc = r.level_step == top and not r.block_y and not r.block_x
            if window.size:
                blocks.decode_block(r.bytes, window, r.level_step >> d, spec.encoder, container.quality_of(spec, chroma[c]), dc, chroma[c], r.level_step)
        present = rows["present"].dropna() if "present" in rows else ()
        if len(present):
            places = _there(present.iloc[0], (spec.height, spec.width), d).ravel().nonzero()[0]
            out = kernels.Cells(h, w, places, out.ravel()[places], by_place=True)
        back = container.untransform_plane(spec, out, chroma[c], d)
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "c": [c], "v": [back.ravel()]})

    return unpacked(needed.groupBy("image_id", "c").applyInPandas(plane, "image_id bigint, c int, v array<int>"), w)


def assemble(coded: DataFrame) -> DataFrame:
    """Blocks to payloads: each level's size table and its blocks, coarse to fine.  image_id, bytes."""
    words = F.expr("unhex(array_join(transform(blocks, b -> concat(" + _word("b.n_words") + ")), ''))")
    level = coded.groupBy("image_id", "level_step").agg(F.sort_array(F.collect_list(F.struct("block_index", "n_words", "bytes"))).alias("blocks"))
    parts = F.concat(words, F.expr("aggregate(blocks, cast('' as binary), (a, b) -> concat(a, b.bytes))"))
    rows = level.select("image_id", F.struct((-F.col("level_step")).alias("order"), parts.alias("bytes")).alias("part"))
    whole = rows.groupBy("image_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("image_id", F.expr("aggregate(parts, cast('' as binary), (a, b) -> concat(a, b.bytes))").alias("bytes"))


def _word(value: str) -> str:
    from .codes import little_endian

    return little_endian(value, 4)


def check_containers(containers: DataFrame, downsampling: int = 0) -> DataFrame:
    """Reads headers and size tables only: image_id, point_of_interest (0: complete), status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for image_id, data in zip(rows["image_id"], rows["bytes"]):
                try:
                    spec, _, payload = container.open_container(bytes(data))
                    made.append((image_id, container.point_of_interest(spec, payload, downsampling)[0], "ok"))
                except UnderflowError:
                    made.append((image_id, None, "UnderflowError"))
                except RasterError as e:
                    made.append((image_id, None, type(e).__name__))
            yield pd.DataFrame(made, columns=["image_id", "point_of_interest", "status"]).astype({"point_of_interest": "Int64"})

    return containers.select("image_id", "bytes").mapInPandas(run, "image_id bigint, point_of_interest bigint, status string")
