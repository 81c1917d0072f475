"""Vectorised integer kernels over planes (2-D arrays): lifting, quantisation, levels.

Division truncates towards zero, which numpy's ``//`` does not; ``tdiv`` does.
A plane without all of its cells is a ``Cells``, which the kernels take as well.
"""

from __future__ import annotations

import numpy as np

#: In a packed plane, no cell at this place.
ABSENT = -(1 << 31)


def tdiv(a: np.ndarray, b: int) -> np.ndarray:
    """Integer division that truncates."""
    q = np.abs(a) // abs(b)
    return np.where((a < 0) != (b < 0), -q, q)


def round_div(a: np.ndarray, b: int) -> np.ndarray:
    """Division to the nearest integer, halves away from zero."""
    return tdiv(a + np.where(a < 0, -(b // 2), b // 2), b)


def cubic(c0, c1, c2, c3) -> np.ndarray:
    """The median of a four-tap interpolation and its two inner taps."""
    guess = round_div(9 * (c1 + c2) - c0 - c3, 16)
    low, high = np.minimum(c1, c2), np.maximum(c1, c2)
    return np.maximum(low, np.minimum(high, guess))


def _taps(side: np.ndarray, first: int, n: int) -> list[np.ndarray]:
    """For targets k = 0..n-1 the neighbours side[first+k-1 .. first+k+2], with the rules at the ends.

    The second is always there; the third falls back to it, and the outer two to the inner ones.
    """
    size = side.shape[1]
    k = np.arange(n) + first
    c1 = side[:, k]
    c2 = np.where(k + 1 < size, side[:, np.minimum(k + 1, size - 1)], c1)
    c0 = np.where(k >= 1, side[:, np.maximum(k - 1, 0)], c1)
    c3 = np.where(k + 2 < size, side[:, np.minimum(k + 2, size - 1)], c2)
    return [c0, c1, c2, c3]


def _pass(a: np.ndarray, kind: str, inverse: bool) -> None:
    """One lifting pass along the second axis of a lattice view, in place."""

    def predict(sign: int) -> None:
        n = a[:, 1::2].shape[1]
        c = _taps(a[:, 0::2], 0, n)
        a[:, 1::2] += sign * (tdiv(c[1] + c[2], 2) if kind == "linear" else cubic(*c))

    def update(sign: int) -> None:
        n = a[:, 2::2].shape[1]
        if n:
            c = _taps(a[:, 1::2], 0, n)
            a[:, 2::2] += sign * (tdiv(c[1] + c[2], 4) if kind == "linear" else tdiv(cubic(*c), 2))

    if inverse:
        update(-1)
        predict(1)
    else:
        predict(-1)
        update(1)


class Cells:
    """The cells of a plane that are there, in row order; nulls are cells of no known value.

    Neighbours are those so many cells away in the row or column, as windows over rows count, or with
    ``by_place`` those so many places away.  Without gaps before the last cell of a row or column both
    are the same; with them only lifting by place can be undone.
    """

    def __init__(self, h: int, w: int, pos: np.ndarray, v: np.ndarray, by_place: bool = False):
        v = np.asarray(v, np.float64)
        self.h, self.w, self.by_place = h, w, by_place
        self.pos = np.asarray(pos, np.int64)
        self.known = ~np.isnan(v)
        self.v = np.where(self.known, v, 0).astype(np.int32)

    def copy(self, v: np.ndarray | None = None) -> Cells:
        out = Cells(self.h, self.w, self.pos, self.v if v is None else v, self.by_place)
        out.known = self.known.copy()
        return out

    def ravel(self) -> np.ndarray:
        """The packed plane."""
        out = np.full(self.h * self.w, ABSENT, np.int32)
        out[self.pos] = self.v
        if not self.known.all():
            out = out.astype(object)
            out[self.pos[~self.known]] = None
        return out

    def steps(self) -> np.ndarray:
        both = self.pos // self.w | self.pos % self.w
        return both & -both

    def lift_pass(self, kind: str, step: int, vertical: bool, update: bool, sign: int) -> None:
        along, across = self.pos % self.w, self.pos // self.w
        if vertical:
            along, across = across, along
        order = np.lexsort((along, across))
        along, across, v, known = along[order], across[order], self.v[order], self.known[order]
        keys = across * (max(self.h, self.w) + 3 * step) + along
        mine = np.flatnonzero((across % step == 0) & (along % (2 * step) == (0 if update else step)) & (along > 0))

        def at(k: int) -> tuple[np.ndarray, np.ndarray]:
            if self.by_place:
                j = np.minimum(np.searchsorted(keys, keys[mine] + k), len(keys) - 1)
                there = keys[j] == keys[mine] + k
            else:
                j = np.clip(mine + k, 0, len(keys) - 1)
                there = (j == mine + k) & (across[j] == across[mine])
            return v[j], there & known[j]

        (c1, has1), (c2, has2) = at(-step), at(step)
        if self.by_place:
            c1 = np.where(has1, c1, np.where(has2, c2, 0))
        else:
            known[mine] &= has1
        c2 = np.where(has2, c2, c1)
        if kind == "linear":
            guess = tdiv(c1 + c2, 4 if update else 2)
        else:
            (c0, has0), (c3, has3) = at(-3 * step), at(3 * step)
            guess = cubic(np.where(has0, c0, c1), c1, c2, np.where(has3, c3, c2))
            guess = tdiv(guess, 2) if update else guess
        v[mine] += sign * guess
        self.v[order], self.known[order] = v, known


def plane_of(v: np.ndarray, pos: np.ndarray | None, h: int, w: int, by_place: bool = False) -> np.ndarray | Cells:
    """A packed plane as the kernels take it; ``pos`` has the places of an incomplete one."""
    v = np.asarray(v)
    if pos is None and v.dtype.kind == "i":
        return np.asarray(v, np.int32).reshape(h, w)
    return Cells(h, w, np.arange(h * w) if pos is None else pos, v, by_place)


def lift(plane: np.ndarray | Cells, kind: str, levels: int | None = None) -> np.ndarray | Cells:
    """Multi-level forward transform of a copy; ``levels`` limits the depth."""
    sparse = isinstance(plane, Cells)
    out = plane.copy() if sparse else np.array(plane, np.int32)
    h, w = (out.h, out.w) if sparse else out.shape
    step, done = 1, 0
    while (step < h or step < w) and (levels is None or done < levels):
        if sparse:
            for size, vertical in ((w, False), (h, True)):
                if step < size:
                    out.lift_pass(kind, step, vertical, False, -1)
                    out.lift_pass(kind, step, vertical, True, 1)
            step, done = 2 * step, done + 1
            continue
        lattice = out[::step, ::step]
        if step < w:
            _pass(lattice, kind, False)
        if step < h:
            _pass(lattice.T, kind, False)
        step, done = 2 * step, done + 1
    return out


def unlift(plane: np.ndarray | Cells, kind: str) -> np.ndarray | Cells:
    sparse = isinstance(plane, Cells)
    out = plane.copy() if sparse else np.array(plane, np.int32)
    h, w = (out.h, out.w) if sparse else out.shape
    step = 1
    while 2 * step < h or 2 * step < w:
        step *= 2
    while step >= 1:
        if sparse:
            for size, vertical in ((h, True), (w, False)):
                if step < size:
                    out.lift_pass(kind, step, vertical, True, -1)
                    out.lift_pass(kind, step, vertical, False, 1)
            step //= 2
            continue
        lattice = out[::step, ::step]
        if step < h:
            _pass(lattice.T, kind, True)
        if step < w:
            _pass(lattice, kind, True)
        step //= 2
    return out


def lift_lines(v: np.ndarray, x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One linear level of lines laid end to end: values, places in their lines, and which are a line's last."""
    out = np.array(v, np.int32)
    for step, by in ((x & 1 == 1, -2), ((x & 1 == 0) & (x > 0), 4)):
        i = np.flatnonzero(step)
        out[i] += np.sign(by) * tdiv(out[i - 1] + out[np.where(last[i], i - 1, i + 1)], abs(by))
    return out


def lift_line_sums(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of lines of bytes, none empty, that start at ``offsets`` (and one end): sums of one level, plain and by place + 1.

    Some ``most`` bytes are lifted at a time; a longer line goes in pieces with the two bytes around them that count.
    """
    n = np.diff(offsets)
    total, weighted = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    k = 0
    while k < len(n):
        if n[k] > most:
            for a in range(0, int(n[k]), most := most + most % 2):
                b = min(a + most, int(n[k]))
                x = np.arange(max(0, a - 2), min(b + 2, int(n[k])), dtype=np.int64)
                v = lift_lines(data[offsets[k] + x[0] : offsets[k] + x[-1] + 1], x, x == x[-1])[a - x[0] : b - x[0]].astype(np.int64)
                total[k] += v.sum()
                weighted[k] += (v * np.arange(a + 1, b + 1)).sum()
            k += 1
            continue
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        starts = offsets[k:end] - offsets[k]
        x = np.arange(offsets[end] - offsets[k], dtype=np.int64) - np.repeat(starts, n[k:end])
        last = np.zeros(len(x), bool)
        last[starts + n[k:end] - 1] = True
        v = lift_lines(data[offsets[k] : offsets[end]], x, last).astype(np.int64)
        total[k:end], weighted[k:end] = np.add.reduceat(v, starts), np.add.reduceat(v * (x + 1), starts)
        k = end
    return total, weighted


def level_steps(h: int, w: int) -> np.ndarray:
    """Lowest set bit of x | y of every cell; 0 at the origin."""
    both = np.arange(h, dtype=np.int64)[:, None] | np.arange(w, dtype=np.int64)[None, :]
    return both & -both


def _level_quality(plane: np.ndarray | Cells, quality: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, and each one's quality and whether it is quantised; levels follow the sides of the whole plane."""
    if isinstance(plane, Cells):
        v, step, side = plane.v.astype(np.int64), plane.steps(), min(plane.h, plane.w)
    else:
        v = np.array(plane, np.int64)
        step, side = level_steps(*v.shape), min(v.shape)
    q = np.maximum(1, np.maximum(low, np.minimum(high, quality * step)))
    return v, q, (step > 0) & (step < side) & (q < high)


def _changed(plane: np.ndarray | Cells, v: np.ndarray) -> np.ndarray | Cells:
    return plane.copy(v) if isinstance(plane, Cells) else v.astype(np.int32)


def quantize(plane: np.ndarray | Cells, quality: int, low: int, high: int) -> np.ndarray | Cells:
    v, q, on = _level_quality(plane, quality, low, high)
    return _changed(plane, np.where(on, tdiv(v * q, high), v))


def dequantize(plane: np.ndarray | Cells, quality: int, low: int, high: int) -> np.ndarray | Cells:
    v, q, on = _level_quality(plane, quality, low, high)
    grown = v * high + np.sign(v) * (high // 2)
    back = np.sign(grown) * (np.abs(grown) // q)
    return _changed(plane, np.where(on, back, v))
