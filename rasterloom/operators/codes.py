"""Golomb-Rice codes as strings of 0 and 1, and words as hex: the part of coding that is plain expressions.

An expression text is made for each starting width.  Values here have at most
17 bits, so the widening of the code ends after a few branches.
"""

from __future__ import annotations

from ..functions.bits import ESCAPE, TOP_POT

MAX_VALUE = (1 << 18) - 1


def unsigned_code(x: str, pot: int, most: int = MAX_VALUE) -> str:
    """SQL text of the code of a non-negative INT expression of at most ``most``."""
    bound = ESCAPE << pot
    low = f"lpad(bin({x} & {(1 << pot) - 1}), {pot}, '0')" if pot else "''"
    plain = f"concat(repeat('0', cast(shiftright({x}, {pot}) as int)), '1', {low})"
    if most < bound:
        return plain
    rest = unsigned_code(f"({x} - {bound})", pot + 4 if pot < 20 else TOP_POT, most - bound)
    return f"case when {x} < {bound} then {plain} else concat('{'0' * ESCAPE}', {rest}) end"


def interleaved_code(x: str, pot: int) -> str:
    return unsigned_code(f"(case when {x} > 0 then 2 * {x} - 1 else -2 * {x} end)", pot)


def signed_code(x: str, pot: int) -> str:
    sign = f"case when {x} > 0 then '1' when {x} < 0 then '0' else '' end"
    return f"concat({unsigned_code(f'abs({x})', pot)}, {sign})"


def words_hex(bits: str) -> str:
    """SQL text: a bit string padded to whole 32-bit words, each written as little-endian hex."""
    word = f"lpad(conv(rpad(substring({bits}, 32 * k + 1, 32), 32, '0'), 2, 16), 8, '0')"
    swapped = f"concat(substring({word}, 7, 2), substring({word}, 5, 2), substring({word}, 3, 2), substring({word}, 1, 2))"
    n = f"cast((length({bits}) + 31) div 32 as int)"
    return f"case when length({bits}) = 0 then '' else array_join(transform(sequence(0, {n} - 1), k -> {swapped}), '') end"


def little_endian(value: str, size: int) -> str:
    """SQL text: an integer as hex of ``size`` bytes, lowest first."""
    text = f"lpad(hex({value}), {2 * size}, '0')"
    return "concat(" + ", ".join(f"substring({text}, {2 * k - 1}, 2)" for k in range(size, 0, -1)) + ")"


def read_little_endian(text: str, at: int, size: int) -> str:
    """SQL text: the integer at byte ``at`` of a hex string."""
    parts = ", ".join(f"substring({text}, {2 * (at + k) + 1}, 2)" for k in range(size - 1, -1, -1))
    return f"cast(conv(concat({parts}), 16, 10) as bigint)"
