"""The three block coders, one block at a time: turbo (runs), fast (decaying moments), contextual (neighbours).

A block is a window of a plane whose cells of one level are visited row by row.
Moments wrap at 32 bits like the unsigned words they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np

from . import bits as B

WORD = 0xFFFFFFFF
#: (rows, columns, weight) in lattice units: the first ring, and the second.
NEAR = ((-2, 0, 4), (0, -2, 4), (-2, -2, 2), (-2, 2, 2))
FAR = ((-4, 0, 2), (0, -4, 2), (-4, -4, 1), (-4, 4, 1))


def scan(h: int, w: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the level's cells, in scan order: odd rows of the lattice whole, even rows at odd places."""
    y, x = np.meshgrid(np.arange(0, h, step), np.arange(0, w, step), indexing="ij")
    mine = ((y | x) & step) > 0
    return y[mine], x[mine]


def cells(h: int, w: int, step: int) -> list[tuple[int, int]]:
    y, x = scan(h, w, step)
    return list(zip(y.tolist(), x.tolist()))


def _square(x: int) -> int:
    return x * x & WORD


def context_cells(y: int, x: int, step: int, h: int, w: int) -> list[tuple[int, int, int]]:
    """(row, column, weight) of the known cells around a cell of a block of h rows and w columns."""
    far = 2 * step
    up, left = (y & ~far) + (y & step), (x & ~far) + (x & step)
    out = [(up - far if up >= h else up, left - far if left >= w else left, 2)]
    if y & step and (x | step) < w:
        out.append((y - step, x | step, 2))
        if x & step:
            out.append((y, x - step, 2))
    for ring, reach in ((NEAR, far), (FAR, 2 * far)):
        if y < reach or x < reach:
            break
        out += [(y + r * step, x + c * step, k) for r, c, k in ring if x + c * step < w]
    return out


def moments(magnitudes: list[tuple[int, int]]) -> tuple[int, int]:
    """16 times the weighted means of (magnitude, weight) pairs and of their squares, rounded."""
    n = sum(k for _, k in magnitudes)
    total = sum(v * k for v, k in magnitudes) & WORD
    squares = sum(_square(min(v, 4096)) * k for v, k in magnitudes) & WORD
    return (total * 16 + n // 2 & WORD) // n, (squares * 16 + n // 2 & WORD) // n


def around(block: list[list[int]], y: int, x: int, step: int) -> tuple[int, int]:
    own = context_cells(y, x, step, len(block), len(block[0]))
    return moments([(abs(block[r][c]), k) for r, c, k in own])


@lru_cache(maxsize=8)
def context_plan(h: int, w: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``context_cells`` of all cells of a level at once: places in the flat block and weights (cells, 11), and weight sums.

    A neighbour that is not known has weight 0.
    """
    y, x = scan(h, w, step)
    far = 2 * step

    def parent(p: np.ndarray, side: int) -> np.ndarray:
        up = (p & ~far) + (p & step)
        return np.where(up >= side, up - far, up)

    every = np.ones(len(y), bool)
    odd_y, odd_x, right = (y & step) > 0, (x & step) > 0, x | step
    sources = [(parent(y, h), parent(x, w), 2, every), (y - step, right, 2, odd_y & (right < w)), (y, x - step, 2, odd_y & odd_x & (right < w))]
    inside = every
    for ring, reach in ((NEAR, far), (FAR, 2 * far)):
        inside = inside & (y >= reach) & (x >= reach)
        sources += [(y + r * step, x + c * step, k, inside & (x + c * step < w)) for r, c, k in ring]
    places = np.stack([np.where(on, r * w + c, 0) for r, c, _, on in sources], axis=1)
    weights = np.stack([on * k for _, _, k, on in sources], axis=1).astype(np.int64)
    return places, weights, weights.sum(axis=1)


def _contexts(flat: np.ndarray, h: int, w: int, step: int) -> tuple[list[int], list[int]]:
    """Both moments of all cells of a level whose values are all known."""
    places, weights, n = context_plan(h, w, step)
    near = np.abs(flat)[places]
    total = ((near * weights).sum(axis=1) & WORD) * 16 + n // 2 & WORD
    capped = np.minimum(near, 4096)
    squares = ((capped * capped * weights).sum(axis=1) & WORD) * 16 + n // 2 & WORD
    return (total // n).tolist(), (squares // n).tolist()


def code_choice(total_sq: int, second: int, chroma: bool) -> tuple[bool, int]:
    """Which code a value gets, by its context: (interleaved rather than signed, pot)."""
    ladder = (
        (2 * second + (250 if chroma else 100), None, 0),
        (2 * second + 950, None, 1),
        (3 * second + 3000, 5 * second + 400, 2),
        (3 * second + 12000, 5 * second + 3000, 3),
        (4 * second + 44000, 6 * second + 12000, 4),
    )
    for bound, inner, pot in ladder:
        if total_sq < bound & WORD:
            return (False, pot - 1) if inner is not None and total_sq < inner & WORD else (True, pot)
    return False, 4


def next_run_coder(fast: bool, now: int, s: int, q: int, context: tuple[int, int], total_sq: int) -> int:
    """The run coder after coding ``s``; it only changes when zeros start or stop being likely."""
    if (s == 0) != (now == 0):
        return now
    first, second = context
    if fast:
        return next((4 - k for k, bound in enumerate((1, 2, 4, 8)) if first < bound), 0)
    if q == 1024:
        return int(first < 2)
    if first < 4 and second < 2:
        return 4
    if first < 8 and second < 4:
        return 3
    if 2 * total_sq & WORD < 3 * second + 48 & WORD:
        return 2
    return int(2 * total_sq & WORD < 5 * second + 32 & WORD)


def turbo_runs(q: int, step: int) -> bool:
    return q == 0 or step < 2048 and q * step < 2048


def _decayed(context: tuple[int, int], s: int) -> tuple[int, int]:
    t = abs(s)
    return ((context[0] * 15 + 7 & WORD) >> 4) + t, ((context[1] * 15 + 7 & WORD) >> 4) + _square(min(t, 4096))


def _turbo_bits(values: np.ndarray, runs: bool) -> list[str]:
    if not runs:
        return [B.interleaved_bits(s, 1) for s in values.tolist()]
    at = np.flatnonzero(values)
    some = values[at]
    before = np.diff(at, prepend=-1) - 1
    out = [B.unsigned_bits(r, 1) + B.interleaved_bits(s, 1) for r, s in zip(before.tolist(), (some + (some < 0)).tolist())]
    tail = len(values) - (int(at[-1]) + 1 if len(at) else 0)
    return out + [B.unsigned_bits(tail, 1)] if tail else out


def _modelled_bits(values: list[int], contexts: tuple[list[int], list[int]] | None, q: int, chroma: bool) -> Iterator[str]:
    """Fast (no contexts given: decaying moments) and contextual codes."""
    context, run, coder, fast = (0, 0), 0, 0, contexts is None
    for k, s in enumerate(values):
        if coder and not s:
            run += 1
            continue
        if coder:
            yield B.unsigned_bits(run, coder)
            run = 0
            s += s < 0
        if not fast:
            context = (contexts[0][k], contexts[1][k])
        total_sq = _square(context[0])
        interleaved, pot = code_choice(total_sq, context[1], chroma)
        yield (B.interleaved_bits if interleaved else B.signed_bits)(s, pot)
        if fast:
            context = _decayed(context, s)
        coder = next_run_coder(fast, coder, s, q, context, total_sq)
    if run:
        yield B.unsigned_bits(run, coder)


def encode_block(block: np.ndarray, step: int, scheme: str, q: int, has_dc: bool, chroma: bool) -> bytes:
    """One block's words."""
    h, w = block.shape
    flat = np.asarray(block, np.int64).ravel()
    y, x = scan(h, w, step)
    values = flat[y * w + x]
    sink = B.BitWriter()
    if has_dc and len(flat):
        sink.parts.append(B.signed_bits(int(flat[0]), 4))
    if scheme == "turbo":
        sink.parts += _turbo_bits(values, turbo_runs(q, step))
    else:
        contexts = _contexts(flat, h, w, step) if scheme == "contextual" else None
        sink.parts += _modelled_bits(values.tolist(), contexts, q, chroma)
    return sink.to_bytes()


def _known_contexts(h: int, w: int, step: int, size: list[int], square: list[int]) -> Iterator[tuple[int, int]]:
    """The moments of one cell after another, from magnitudes and capped squares that the caller keeps up to date."""
    places, weights, n = context_plan(h, w, step)
    for at in range(0, len(n), 4096):
        own = slice(at, at + 4096)
        for near, k, m in zip(places[own].tolist(), weights[own].tolist(), n[own].tolist()):
            total = sum(map(mul, [size[p] for p in near], k)) & WORD
            squares = sum(map(mul, [square[p] for p in near], k)) & WORD
            yield (total * 16 + m // 2 & WORD) // m, (squares * 16 + m // 2 & WORD) // m


def decode_block(data: bytes, block: np.ndarray, step: int, scheme: str, q: int, has_dc: bool, chroma: bool, full_step: int | None = None) -> None:
    """Fills the level's cells of ``block``, which already holds the coarser levels.

    ``full_step`` is the step at which a downsampled level was coded; it decides whether turbo used runs.
    """
    bits = B.BitReader(data)
    h, w = block.shape
    flat = np.asarray(block, np.int64).ravel()
    if has_dc and len(flat):
        flat[0] = B.read_signed(bits, 4)
    contextual, fast, turbo = scheme == "contextual", scheme == "fast", scheme == "turbo"
    y, x = scan(h, w, step)
    places = (y * w + x).tolist()
    size = np.abs(flat).tolist() if contextual else []
    square = [min(v, 4096) ** 2 for v in size]
    contexts = _known_contexts(h, w, step, size, square)
    out = []
    context, run = (0, 0), -1
    coder = int(turbo and turbo_runs(q, full_step or step))
    for place in places:
        if contextual:
            context = next(contexts)
        if coder and run == -1:
            run = B.read_unsigned(bits, coder)
        if run > 0:
            run -= 1
            s = 0
        else:
            if turbo:
                s = B.read_interleaved(bits, 1)
            else:
                total_sq = _square(context[0])
                interleaved, pot = code_choice(total_sq, context[1], chroma)
                s = (B.read_interleaved if interleaved else B.read_signed)(bits, pot)
                if fast:
                    context = _decayed(context, s)
                coder = next_run_coder(fast, coder, s, q, context, total_sq)
            if run == 0 and s <= 0:
                s -= 1
            run = -1
        out.append(s)
        if contextual:
            size[place] = abs(s)
            square[place] = min(abs(s), 4096) ** 2
    flat[places] = out
    block[...] = flat.reshape(h, w)
