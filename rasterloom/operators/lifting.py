"""Multi-level integer lifting of long planes, and its inverse.

Two ways with one meaning.  ``lift_windows`` is made of lag and lead only: after
one ``repartition`` by image the passes along rows and along columns need no
further exchange.  Its plan grows by four windows a level, so it suits a few
levels.  ``lift`` packs planes into arrays (one shuffle) and runs all levels in
one pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..spec import Spec
from .layout import packed, unpacked


def _guess(kind: str, update: bool, window, step: int) -> Column:
    """What a cell's neighbours predict for it."""
    c1 = F.lag("v", step).over(window)
    c2 = F.coalesce(F.lead("v", step).over(window), c1)
    if kind == "linear":
        both = c1 + c2
        return F.call_function("div", both, F.lit(4 if update else 2))
    c0 = F.coalesce(F.lag("v", 3 * step).over(window), c1)
    c3 = F.coalesce(F.lead("v", 3 * step).over(window), c2)
    wide = 9 * (c1 + c2) - c0 - c3
    near = F.call_function("div", wide + F.when(wide < 0, -8).otherwise(8), F.lit(16))
    middle = F.greatest(F.least(c1, c2), F.least(F.greatest(c1, c2), near))
    return F.call_function("div", middle, F.lit(2)) if update else middle


def _pass(cells: DataFrame, kind: str, step: int, along: str, across: str, update: bool, sign: int) -> DataFrame:
    window = Window.partitionBy("image_id", "c", across).orderBy(along)
    mine = F.col(along) % (2 * step) == (0 if update else step)
    target = (F.col(across) % step == 0) & mine & (F.col(along) > 0)
    return cells.withColumn("v", F.when(target, F.col("v") + sign * _guess(kind, update, window, step)).otherwise(F.col("v")).cast("int"))


def _spread(cells: DataFrame, one_channel: bool) -> DataFrame:
    return cells.repartition("image_id") if one_channel else cells.repartition("image_id", "c")


def lift_windows(cells: DataFrame, spec: Spec, levels: int | None = None) -> DataFrame:
    out, step, done = _spread(cells, spec.channels * spec.layers == 1), 1, 0
    while (step < spec.height or step < spec.width) and (levels is None or done < levels):
        for size, along, across in ((spec.width, "x", "y"), (spec.height, "y", "x")):
            if step < size:
                out = _pass(out, spec.filter, step, along, across, False, -1)
                out = _pass(out, spec.filter, step, along, across, True, 1)
        step, done = 2 * step, done + 1
    return out


def unlift_windows(cells: DataFrame, spec: Spec, levels: int | None = None) -> DataFrame:
    steps = spec.steps()
    out = _spread(cells, spec.channels * spec.layers == 1)
    for step in steps if levels is None else steps[len(steps) - levels :]:
        for size, along, across in ((spec.height, "y", "x"), (spec.width, "x", "y")):
            if step < size:
                out = _pass(out, spec.filter, step, along, across, True, -1)
                out = _pass(out, spec.filter, step, along, across, False, 1)
    return out


def lift_line_sums(lines: DataFrame) -> DataFrame:
    """One linear level of images of one row given as bytes (image_id, data): image_id, n, total, weighted.

    What sums of ``lift_windows`` with ``levels=1`` give, without a row for each cell; an image without bytes has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data = rows.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            full = np.diff(offsets) > 0
            if full.any():
                starts = np.append(offsets[:-1][full], offsets[-1])
                total, weighted = kernels.lift_line_sums(np.frombuffer(data.buffers()[2], np.uint8), starts)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(full)), *map(pa.array, (np.diff(starts), total, weighted))], ["image_id", "n", "total", "weighted"])

    return lines.where("data is not null").select("image_id", "data").mapInArrow(run, "image_id bigint, n bigint, total bigint, weighted bigint")


def over_planes(planes: DataFrame, height: int, width: int, change, by_place: bool = False) -> DataFrame:
    """Applies ``change(plane, c)`` to each packed plane; an Arrow batch holds few planes.  ``by_place``: see ``kernels.Cells``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            planes_in = (kernels.plane_of(v, pos, height, width, by_place) for v, pos in zip(rows["v"], rows["pos"]))
            new = [change(p, c).ravel() for p, c in zip(planes_in, rows["c"])]
            yield rows[["image_id", "c"]].assign(v=new)

    return planes.mapInPandas(run, "image_id bigint, c int, v array<int>")


def lift(cells: DataFrame, spec: Spec, levels: int | None = None, by_place: bool = False) -> DataFrame:
    kind = spec.filter
    planes = over_planes(packed(cells, spec), spec.height, spec.width, lambda p, c: kernels.lift(p, kind, levels), by_place)
    return unpacked(planes, spec.width)


def unlift(cells: DataFrame, spec: Spec, by_place: bool = False) -> DataFrame:
    kind = spec.filter
    planes = over_planes(packed(cells, spec), spec.height, spec.width, lambda p, c: kernels.unlift(p, kind), by_place)
    return unpacked(planes, spec.width)
