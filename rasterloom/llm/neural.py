"""Small numpy networks: a bidirectional gated recurrent layer with backpropagation through time, and Adam.

Arrays are feature-major, (directions, features, batch), so gates are contiguous
blocks.  The layer is driven by input gates that the caller looks up for each
position, which lets byte tables and word tables share it.  Sigmoids are taken
as ``(1 + tanh(x / 2)) / 2``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

f32 = np.float32


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * f32(scale)
            self.m[k] += f32(0.1) * (g - self.m[k])
            self.v[k] += f32(0.001) * (g * g - self.v[k])
            self.params[k] -= f32(self.rate * fix) * self.m[k] / (np.sqrt(self.v[k]) + f32(1e-8))


def uniform(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    scale = scale or 1 / np.sqrt(shape[-1])
    return rng.uniform(-scale, scale, shape).astype(f32)


def gru_params(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    """Recurrent weights of both directions; gate rows are update, reset, candidate."""
    return {"U": uniform(rng, 2, 3 * hidden, hidden), "bn": np.zeros((2, hidden, 1), f32)}


def even_product(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``a @ b``, each column of ``b`` by itself: equal columns get equal sums wherever they stand, which BLAS does not give."""
    if b.shape[-1] == 1:  # a single column would be summed in another order
        two = even_product(a, np.repeat(b, 2, axis=-1))[..., :1]
        return two if out is None else np.copyto(out, two) or out
    return np.einsum("...ik,...kn->...in", np.ascontiguousarray(a), np.ascontiguousarray(b), out=out)


def row_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, each row of ``x`` by itself."""
    out = even_product(np.atleast_2d(w.T), x.T).T
    return np.ascontiguousarray(out[:, 0] if w.ndim == 1 else out)


def gru_forward(p: dict, gates: Callable[[int, np.ndarray], None], steps: int, batch: int, keep: bool, product: Callable = np.matmul):
    """Runs both directions over ``steps``; ``gates(t, out)`` fills the input gates (2, 3H, batch), whose first
    direction is position t and whose second is position steps-1-t.

    Yields (t, h) with h (2, H, batch), valid until the next step, and, where ``keep`` is set, what the
    backward pass needs.
    """
    H = p["U"].shape[2]
    half = np.ones((1, 3 * H, 1), f32)
    half[:, : 2 * H] = 0.5
    U = p["U"] * half
    h = np.zeros((2, H, batch), f32)
    g, x = np.empty((2, 3 * H, batch), f32), np.empty((2, 3 * H, batch), f32)
    zr, n = np.empty((2, 2 * H, batch), f32), np.empty((2, H, batch), f32)
    for t in range(steps):
        gates(t, x)
        product(U, h, out=g)
        np.multiply(x[:, : 2 * H], f32(0.5), out=zr)
        zr += g[:, : 2 * H]
        np.tanh(zr, out=zr)
        zr *= f32(0.5)
        zr += f32(0.5)
        c = g[:, 2 * H :]
        c += p["bn"]
        np.multiply(c, zr[:, H:], out=n)
        n += x[:, 2 * H :]
        np.tanh(n, out=n)
        saved = (h.copy(), zr.copy(), n.copy(), c.copy()) if keep else None
        h -= n
        h *= zr[:, :H]
        h += n
        yield t, h, saved


def gru_backward(p: dict, saved: list, dh_at: Callable[[int], np.ndarray]) -> tuple[dict, list[np.ndarray]]:
    """Backpropagation through time.  ``dh_at(t)`` is the loss's gradient at the output of step t.

    Returns gradients of U and bn, and of the input gates of each step.
    """
    U = p["U"]
    H = U.shape[2]
    dU, dbn = np.zeros_like(U), np.zeros_like(p["bn"])
    dx: list[np.ndarray] = [None] * len(saved)  # type: ignore[list-item]
    dh = np.zeros_like(saved[0][0])
    Ut = U.transpose(0, 2, 1)
    for t in range(len(saved) - 1, -1, -1):
        h, zr, n, c = saved[t]
        z, r = zr[:, :H], zr[:, H:]
        dh = dh + dh_at(t)
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * c * r * (1 - r)
        dc = dn * r
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dc], axis=1)
        dU += dg @ h.transpose(0, 2, 1)
        dbn += dc.sum(axis=2, keepdims=True)
        dh = dh * z + Ut @ dg
    return {"U": dU, "bn": dbn}, dx


def column_sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """(features, n) summed by ``index`` (n) to (features, size)."""
    return np.stack([np.bincount(index, row, size) for row in values]).astype(f32)


def fold(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, mod: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` documents of each class, chosen by a hash of their id.

    Rows whose fold is the held-out one are never read as labels; null labels and ids are left out.
    The id list has at most ``2 * per_class`` rows, so it is broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", mod) != out))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionAll(pick(1))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
