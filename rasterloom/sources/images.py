"""Image files: portable maps of 8 bits (P5 grey, P6 colour, P7 with alpha), read and written without other libraries.

A batch of files of any sizes becomes containers in one pass over ``binaryFile``
rows; each file gets a specification of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MalformedError, RasterError
from ..functions import container
from ..spec import Program, Spec

CHANNELS = {"generic": 1, "rgb": 3, "rgba": 4, "bgr": 3, "bgra": 4}
PROGRAMS = {"none": Program(), "yuv444": Program.yuv444(), "uyv": Program.uyv(), "a710_bgr": Program.a710_bgr(), "a710_rgb": Program.a710_rgb()}


def parse(data: bytes) -> np.ndarray:
    """A portable map to samples (height, width, channels)."""
    fields: list[bytes] = []
    at = 0

    def token() -> bytes:
        nonlocal at
        while at < len(data) and data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        start = at
        while at < len(data) and not data[at : at + 1].isspace():
            at += 1
        return data[start:at]

    magic = token()
    try:
        if magic == b"P7":
            head = {}
            while (name := token()) != b"ENDHDR":
                if not name:
                    raise MalformedError("the header has no end")
                head[name] = token()
            w, h, n, top = (int(head[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        elif magic in (b"P5", b"P6"):
            fields = [token() for _ in range(3)]
            w, h, top = map(int, fields)
            n = 1 if magic == b"P5" else 3
        else:
            raise MalformedError("not a binary portable map")
    except (ValueError, KeyError) as e:
        if isinstance(e, RasterError):
            raise
        raise MalformedError("a header field is missing") from e
    body = data[at + 1 : at + 1 + w * h * n]
    if top != 255 or min(w, h, n) < 1 or len(body) < w * h * n:
        raise MalformedError("samples must have 8 bits, and all must be there")
    return np.frombuffer(body, np.uint8).reshape(h, w, n)


def write(samples: np.ndarray) -> bytes:
    h, w, n = samples.shape
    if n in (1, 3):
        head = f"P{5 if n == 1 else 6}\n{w} {h}\n255\n"
    else:
        head = f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {n}\nMAXVAL 255\nENDHDR\n"
    return head.encode() + np.ascontiguousarray(samples, np.uint8).tobytes()


def arrange(samples: np.ndarray, intent: str | None) -> tuple[np.ndarray, str]:
    """Samples of a map (grey, RGB or RGBA) in the channel order that an intent asks for; alpha is dropped or opaque."""
    own = {1: "generic", 3: "rgb", 4: "rgba"}.get(samples.shape[2], "generic")
    intent = intent or own
    want = CHANNELS.get(intent)
    if want is None or own == "generic" and intent != "generic":
        if own != "generic" or samples.shape[2] != 1 or want is None:
            raise MalformedError(f"samples of {samples.shape[2]} channels can't become {intent}")
        samples = np.repeat(samples, 3, axis=2)
    if intent == "generic":
        return samples, intent
    if want == 4 and samples.shape[2] == 3:
        samples = np.concatenate([samples, np.full_like(samples[:, :, :1], 255)], axis=2)
    samples = samples[:, :, :want]
    if intent.startswith("bgr"):
        samples = samples[:, :, [2, 1, 0, 3][:want]]
    return samples, intent


def compress(data: bytes, intent: str | None = None, program: str = "none", **options) -> bytes:
    """A portable map to a container; ``options`` are fields of ``Spec``."""
    samples, intent = arrange(parse(data), intent)
    h, w, n = samples.shape
    return container.encode_image(Spec(w, h, n, intent=intent, **options), PROGRAMS[program], samples.tobytes())


def decompress(data: bytes, downsampling: int = 0) -> bytes:
    """A container of one layer to a portable map in RGB order."""
    spec, _, _ = container.open_container(data)
    if spec.layers != 1:
        raise MalformedError("a map has one layer")
    pixels, _ = container.decode_image(data, downsampling)
    w, h = spec.downsampled(downsampling)
    samples = np.frombuffer(pixels, np.uint8).reshape(h, w, spec.channels)
    if spec.intent in ("bgr", "bgra"):
        samples = samples[:, :, [2, 1, 0, 3][: spec.channels]]
    return write(samples)


def _over_files(rows: DataFrame, change) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    made.append((path, change(bytes(data)), "ok"))
                except RasterError as e:
                    made.append((path, None, type(e).__name__))
            yield pd.DataFrame(made, columns=["path", "bytes", "status"])

    return rows.select("path", "content").mapInPandas(run, "path string, bytes binary, status string")


def compress_files(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """Portable maps to containers: path, bytes, status; a file that can't be read gets a status and null bytes."""
    return _over_files(spark.read.format("binaryFile").load(pattern), lambda data: compress(data, **options))


def decompress_files(containers: DataFrame, downsampling: int = 0) -> DataFrame:
    """``path, bytes`` of containers to portable maps."""
    return _over_files(containers.select("path", F.col("bytes").alias("content")), lambda data: decompress(data, downsampling))
