"""Containers that arrive in pieces: which levels of each image can already be shown.

A stream of ``image_id, offset, bytes`` (pieces of payloads, in any order) keeps
the longest gapless prefix of each image as state, and emits a row whenever more
levels have become complete.  State holds the size walk, not decoded pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import UnderflowError
from ..functions import container
from ..spec import Spec

OUT = "image_id bigint, have long, finest_step int, point_of_interest long"


def ready_levels(spec: Spec, prefix: bytes) -> tuple[int, int]:
    """(finest step whose blocks are all there, or 0; next point of interest)."""
    finest, target = 0, len(prefix) + 1024
    try:
        target, levels = container.point_of_interest(spec, prefix)
    except UnderflowError:
        levels = []
        for cut in range(len(spec.steps())):
            try:
                target, levels = container.point_of_interest(spec, prefix, len(spec.steps()) - 1 - cut)
            except UnderflowError:
                break
    for step, at, sizes in levels:
        if at + sum(sizes) <= len(prefix):
            finest = step
    return finest, target


def progress(pieces: DataFrame, spec: Spec) -> DataFrame:
    """Rows of ``image_id, have, finest_step, point_of_interest``, one for each advance of an image."""

    def advance(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, shown, waiting = state.get if state.exists else (b"", 0, {})
        known, waiting = bytes(known), {int(k): bytes(v) for k, v in dict(waiting).items()}
        for rows in frames:
            for at, data in zip(rows["offset"], rows["bytes"]):
                at, data = int(at), bytes(data)
                if len(data) > len(waiting.get(at, b"")):
                    waiting[at] = data
        grown = True
        while grown:
            grown = False
            for at in sorted(waiting):
                if at <= len(known):
                    data = waiting.pop(at)
                    if at + len(data) > len(known):
                        known += data[len(known) - at :]
                        grown = True
        finest, target = ready_levels(spec, known)
        news = finest != shown
        state.update((known, finest, waiting))
        if news:
            yield pd.DataFrame({"image_id": [key[0]], "have": [len(known)], "finest_step": [finest], "point_of_interest": [target]})

    kept = "known binary, shown int, waiting map<bigint, binary>"
    return pieces.groupBy("image_id").applyInPandasWithState(advance, OUT, kept, "append", GroupStateTimeout.NoTimeout)
