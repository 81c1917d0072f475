"""Bit streams and limited-length Golomb-Rice codes.

Bits fill 32-bit words from the top; words are little-endian bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..errors import UnderflowError

ESCAPE = 12
TOP_POT = 24


class BitWriter:
    def __init__(self, limit: int | None = None):
        self.parts: list[str] = []
        self.limit = limit

    def put(self, value: int, bits: int) -> None:
        if value >> bits:
            raise ValueError(f"{value} does not fit {bits} bits")
        if bits:
            self.parts.append(format(value, f"0{bits}b"))

    def bits(self) -> str:
        return "".join(self.parts)

    def to_bytes(self) -> bytes:
        """All bits, padded with zeros to whole words."""
        text = self.bits()
        text += "0" * (-len(text) % 32)
        if not text:
            return b""
        out = np.frombuffer(int(text, 2).to_bytes(len(text) // 8, "big"), ">u4").astype("<u4").tobytes()
        if self.limit is not None and len(out) > self.limit:
            raise UnderflowError("the sink is full")
        return out


class BitReader:
    def __init__(self, data: bytes):
        whole = len(data) // 4 * 4
        raw = np.frombuffer(data, "<u4", whole // 4).astype(">u4").tobytes()
        self.text = format(int.from_bytes(raw, "big"), f"0{8 * whole}b") if whole else ""
        self.at = 0

    def get(self, bits: int) -> int:
        if not bits:
            return 0
        end = self.at + bits
        if end > len(self.text):
            raise UnderflowError("no bits are left")
        value = int(self.text[self.at : end], 2)
        self.at = end
        return value

    def zeros(self, most: int) -> int:
        """Counts zeros up to ``most``; the one that ends a shorter run is consumed."""
        end = self.text.find("1", self.at, self.at + most)
        if end < 0:
            if self.at + most > len(self.text):
                raise UnderflowError("no bits are left")
            self.at += most
            return most
        n = end - self.at
        self.at = end + 1
        return n

    def words_used(self) -> int:
        return -(-self.at // 32)


@lru_cache(maxsize=1 << 14)
def unsigned_bits(x: int, pot: int) -> str:
    """The code of a non-negative number: unary quotient by 2**pot, then the remainder; 12 zeros escape to a larger pot."""
    head = ""
    while x >> pot >= ESCAPE:
        head += "0" * ESCAPE
        x -= ESCAPE << pot
        pot = pot + 4 if pot < 20 else TOP_POT
    tail = format(x & ((1 << pot) - 1), f"0{pot}b") if pot else ""
    return head + "0" * (x >> pot) + "1" + tail


def interleaved_bits(x: int, pot: int) -> str:
    return unsigned_bits(2 * x - 1 if x > 0 else -2 * x, pot)


def signed_bits(x: int, pot: int) -> str:
    return unsigned_bits(abs(x), pot) + ("" if x == 0 else "1" if x > 0 else "0")


def read_unsigned(bits: BitReader, pot: int) -> int:
    base = 0
    while True:
        zeros, own = bits.zeros(ESCAPE), min(pot, TOP_POT)
        if pot < 108 and zeros == ESCAPE:
            base += ESCAPE << own
            pot = min(pot + 4, 108)
            continue
        return (base + (zeros << own) + bits.get(own)) & 0xFFFFFFFF


def _as_i32(x: int) -> int:
    return x - (1 << 32) if x >> 31 else x


def read_interleaved(bits: BitReader, pot: int) -> int:
    x = _as_i32(read_unsigned(bits, pot))
    return (x + 1) // 2 if x & 1 else -(x // 2)


def read_signed(bits: BitReader, pot: int) -> int:
    x = _as_i32(read_unsigned(bits, pot))
    return x if x == 0 or bits.get(1) else -x


def write_signed(out: BitWriter, x: int, pot: int) -> None:
    out.parts.append(signed_bits(x, pot))
