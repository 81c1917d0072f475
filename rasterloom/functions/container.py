"""Containers of one image: size tables and blocks of all levels, coarse to fine."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np

from ..errors import UnderflowError
from ..spec import Program, Spec
from . import blocks, kernels


def block_windows(spec: Spec, step: int, d: int = 0) -> Iterator[tuple[int, int, int, slice, slice]]:
    """(channel, by, bx, rows, columns) of each block of a level, in storage order; ``d`` shrinks the windows."""
    nx, ny = spec.block_grid(step)
    side = (step >> d) << spec.block_size
    for c in range(spec.channels * spec.layers):
        for by in range(ny):
            for bx in range(nx):
                yield c, by, bx, slice(by * side, (by + 1) * side), slice(bx * side, (bx + 1) * side)


def quality_of(spec: Spec, chroma: bool) -> int:
    return spec.chroma_quality if chroma else spec.quality


def transform_plane(spec: Spec, plane: np.ndarray | kernels.Cells, chroma: bool) -> np.ndarray | kernels.Cells:
    return kernels.quantize(kernels.lift(plane, spec.filter), quality_of(spec, chroma), 0, 1024 * spec.boost)


def untransform_plane(spec: Spec, plane: np.ndarray | kernels.Cells, chroma: bool, d: int = 0) -> np.ndarray | kernels.Cells:
    return kernels.unlift(kernels.dequantize(plane, quality_of(spec, chroma) << d, 0, 1024 * spec.boost), spec.filter)


def transform(spec: Spec, planes: np.ndarray, chroma: list[bool]) -> np.ndarray:
    """Lifts and quantises planes (channels, h, w)."""
    return np.stack([transform_plane(spec, p, c) for p, c in zip(planes, chroma)])


def untransform(spec: Spec, planes: np.ndarray, chroma: list[bool], d: int = 0) -> np.ndarray:
    return np.stack([untransform_plane(spec, p, c, d) for p, c in zip(planes, chroma)])


def level_payload(spec: Spec, coded: np.ndarray, chroma: list[bool], step: int, has_dc: bool) -> bytes:
    parts = []
    for c, by, bx, ys, xs in block_windows(spec, step):
        window = coded[c, ys, xs]
        parts.append(blocks.encode_block(window, step, spec.encoder, quality_of(spec, chroma[c]), has_dc and not by and not bx, chroma[c]))
    return struct.pack(f"<{len(parts)}I", *(len(p) // 4 for p in parts)) + b"".join(parts)


def encode_planes(spec: Spec, planes: np.ndarray, chroma: list[bool]) -> bytes:
    """Boosted planes to the payload: every level's size table and blocks."""
    coded = transform(spec, planes, chroma)
    return b"".join(level_payload(spec, coded, chroma, step, k == 0) for k, step in enumerate(spec.steps()))


def walk(spec: Spec, read_at: Callable[[int, int], bytes], size: int, d: int = 0) -> Iterator[tuple[int, int, list[int]]]:
    """(step, offset of the first block, sizes in bytes) of each level that a payload of ``size`` bytes has a size table of.

    ``read_at(n, offset)`` reads size tables only; a coarser level cut short within its blocks is an underflow.
    """
    at = 0
    for step in spec.steps():
        if not step >> d:
            return
        nx, ny = spec.block_grid(step)
        n = nx * ny * spec.channels * spec.layers
        if at > size:
            raise UnderflowError("a coarser level is cut short")
        if size - at <= 4 * n:
            return
        sizes = [4 * k for k in struct.unpack(f"<{n}I", read_at(4 * n, at))]
        yield step, at + 4 * n, sizes
        at += 4 * n + sum(sizes)


def point_of_interest(spec: Spec, data: bytes, d: int = 0) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """Where the reader wants data up to (0: all is there), and the levels of ``walk``."""
    found = list(walk(spec, lambda n, at: data[at : at + n], len(data), d))
    if not found:
        return (len(data) + 1024 if spec.steps()[0] >> d else 0), found
    step, at, sizes = found[-1]
    end = at + sum(sizes)
    complete = not step >> d + 1 and len(data) >= end
    return (0 if complete else end + (16 * len(sizes) if step >> d > 1 else 0)), found


def decode_planes(spec: Spec, data: bytes, chroma: list[bool], d: int = 0, test: bool = False) -> tuple[np.ndarray, int]:
    """The payload to planes downsampled by 2**d, and the next point of interest; blocks cut short stay zero."""
    w, h = spec.downsampled(d)
    planes = np.zeros((spec.channels * spec.layers, h, w), np.int32)
    target, levels = point_of_interest(spec, data, d)
    if test:
        return planes, target
    for k, (step, at, sizes) in enumerate(levels):
        for (c, by, bx, ys, xs), size in zip(block_windows(spec, step, d), sizes):
            window = planes[c, ys, xs]
            if at + size <= len(data) and window.size:
                q = quality_of(spec, chroma[c])
                blocks.decode_block(data[at : at + size], window, step >> d, spec.encoder, q, k == 0 and not by and not bx, chroma[c], step)
            at += size
    return untransform(spec, planes, chroma, d), target


def mix_forward(program: Program, raw: np.ndarray, boost: int) -> np.ndarray:
    """Raw planes (channels, ...) to mixed and boosted ones."""
    out = np.array(raw, np.int32) * boost
    for m in program:
        if m.mixes:
            total = sum(f * out[src] for src, f in m.factors)
            out[m.dest] += kernels.tdiv(np.asarray(total), m.denom)
    return out


def mix_back(program: Program, mixed: np.ndarray, boost: int) -> np.ndarray:
    """The inverse of ``mix_forward``, clamped to bytes."""
    out = np.array(mixed, np.int32)
    for m in reversed(program.mixes):
        if m.mixes:
            total = sum(f * out[src] for src, f in m.factors)
            out[m.dest] -= kernels.tdiv(np.asarray(total), m.denom)
    return np.clip(kernels.tdiv(out, boost), 0, 255)


def interleaved_to_planes(spec: Spec, data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(spec.layers, spec.channel_size, spec.channels)
    return flat.transpose(0, 2, 1).reshape(spec.layers * spec.channels, spec.height, spec.width)


def planes_to_interleaved(planes: np.ndarray, layers: int) -> bytes:
    n = planes.shape[0] // layers
    return planes.reshape(layers, n, -1).transpose(0, 2, 1).astype(np.uint8).tobytes()


def encode_image(spec: Spec, program: Program, data: bytes) -> bytes:
    """Interleaved bytes to a whole container: header, program and payload."""
    chroma = program.chroma_flags(spec.channels * spec.layers)
    planes = mix_forward(program, interleaved_to_planes(spec, data), spec.boost)
    return spec.to_bytes() + program.to_bytes() + encode_planes(spec, planes, chroma)


def read_head(read_at: Callable[[int, int], bytes]) -> tuple[Spec, Program, int]:
    """Header, program and where the payload starts, from a few short reads."""
    spec, most = Spec.from_bytes(read_at(32, 0)), 256
    while True:
        head = read_at(most, 32 + spec.metadata_size)
        try:
            program, used = Program.from_bytes(head, spec.channels * spec.layers)
            return spec, program, 32 + spec.metadata_size + used
        except UnderflowError:
            if len(head) < most:
                raise
            most *= 4


def open_container(data: bytes) -> tuple[Spec, Program, bytes]:
    spec, program, start = read_head(lambda n, at: data[at : at + n])
    return spec, program, data[start:]


def decode_image(data: bytes, d: int = 0) -> tuple[bytes, int]:
    """A container to interleaved bytes downsampled by 2**d, and the next point of interest."""
    spec, program, payload = open_container(data)
    chroma = program.chroma_flags(spec.channels * spec.layers)
    planes, target = decode_planes(spec, payload, chroma, d)
    return planes_to_interleaved(mix_back(program, planes, spec.boost), spec.layers), target
