"""Image specifications and channel programs: the metadata that plans are built from.

Header fields are validated more strictly than some codecs do: counts and
chroma scale of zero, block sizes below 2 and denominators below 1 are errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from .errors import HeaderError, MalformedError
from .functions.bits import BitReader, BitWriter, read_signed, write_signed

MAGIC = 0x58574647  # the container's four magic bytes as a little-endian word
FILTERS = {"linear": 0, "cubic": 1}
QUANTIZATIONS = {"scalar": 0}
ENCODERS = {"turbo": 0, "fast": 1, "contextual": 2}
INTENTS = {"generic": 0, "rgb": 7, "rgba": 8, "bgr": 10, "bgra": 11, "yuv444": 12}
LOSSLESS = 1024
SIDE_LIMIT = 1 << 30


def _name(table: dict[str, int], code: int, what: str) -> str:
    for name, value in table.items():
        if value == code:
            return name
    raise HeaderError(f"unknown {what}: {code}")


@dataclass(frozen=True)
class Spec:
    """One image's header."""

    width: int
    height: int
    channels: int = 1
    layers: int = 1
    quality: int = LOSSLESS
    chroma_scale: int = 8
    block_size: int = 7
    filter: str = "linear"
    encoder: str = "contextual"
    intent: str = "generic"
    quantization: str = "scalar"
    version: int = 1
    bit_depth: int = 8
    is_signed: bool = False
    metadata_size: int = 0

    def __post_init__(self):
        def inside(name: str, low: int, high: int) -> None:
            value = getattr(self, name)
            if not low <= value <= high:
                raise HeaderError(f"{name} must be from {low} to {high}, not {value}")

        inside("width", 1, SIDE_LIMIT - 1)
        inside("height", 1, SIDE_LIMIT - 1)
        inside("channels", 1, 65_536)
        inside("layers", 1, 65_536)
        inside("quality", 1, LOSSLESS)
        inside("chroma_scale", 1, 255)
        inside("block_size", 2, 30)
        if self.is_signed or self.bit_depth != 8:
            raise HeaderError("samples must be unsigned and have 8 bits")
        if self.metadata_size < 0 or self.metadata_size % 4:
            raise HeaderError("metadata must fill whole 32-bit words")
        for value, table, what in (
            (self.filter, FILTERS, "filter"),
            (self.encoder, ENCODERS, "encoder"),
            (self.intent, INTENTS, "intent"),
            (self.quantization, QUANTIZATIONS, "quantization"),
        ):
            if value not in table:
                raise HeaderError(f"unknown {what}: {value}")
        if self.image_size >= 1 << 63:
            raise HeaderError("the image is too large to address")

    @property
    def channel_size(self) -> int:
        return self.width * self.height

    @property
    def image_size(self) -> int:
        return self.channel_size * self.channels * self.layers

    @property
    def boost(self) -> int:
        return 1 if self.quality == LOSSLESS else 8

    @property
    def chroma_quality(self) -> int:
        return max(1, (self.quality + self.chroma_scale // 2) // self.chroma_scale)

    def downsampled(self, d: int) -> tuple[int, int]:
        """Width and height after dropping the ``d`` finest levels."""
        scale = 1 << d
        return -(-self.width // scale), -(-self.height // scale)

    def decoded_size(self, d: int) -> int:
        w, h = self.downsampled(d)
        return w * h * self.channels * self.layers

    def steps(self) -> list[int]:
        """Level steps from the coarsest to 1."""
        step = 1
        while step * 2 < max(self.width, self.height):
            step *= 2
        return [step >> k for k in range(step.bit_length())]

    def block_grid(self, step: int) -> tuple[int, int]:
        side = step << self.block_size
        return -(-self.width // side), -(-self.height // side)

    def to_bytes(self) -> bytes:
        packed = self.block_size - 2 | (self.chroma_scale - 1) << 5 | (self.quality - 1) << 13 | int(self.is_signed) << 23
        codes = INTENTS[self.intent], ENCODERS[self.encoder], QUANTIZATIONS[self.quantization], FILTERS[self.filter]
        head = struct.pack("<IIIIHH", MAGIC, self.version, self.width, self.height, self.channels - 1, self.layers - 1)
        return head + packed.to_bytes(3, "little") + bytes((self.bit_depth - 1, *codes)) + struct.pack("<I", self.metadata_size // 4)

    @classmethod
    def from_bytes(cls, data: bytes) -> Spec:
        if len(data) < 32:
            raise HeaderError("a header has 32 bytes")
        magic, version, width, height, channels, layers = struct.unpack_from("<IIIIHH", data)
        if magic != MAGIC:
            raise HeaderError("not a container")
        packed = int.from_bytes(data[20:23], "little")
        depth, intent, encoder, quantization, filter_ = data[23:28]
        return cls(
            width, height, channels + 1, layers + 1, (packed >> 13 & 0x3FF) + 1, (packed >> 5 & 0xFF) + 1, (packed & 31) + 2,
            _name(FILTERS, filter_, "filter"), _name(ENCODERS, encoder, "encoder"), _name(INTENTS, intent, "intent"),
            _name(QUANTIZATIONS, quantization, "quantization"), version, depth + 1, bool(packed >> 23 & 1),
            4 * struct.unpack_from("<I", data, 28)[0],
        )

    def with_(self, **changes) -> Spec:
        return replace(self, **changes)


@dataclass(frozen=True)
class Mix:
    """``dest += trunc(sum of factor * source / denom)``, with sources as they are after earlier steps."""

    dest: int
    factors: tuple[tuple[int, int], ...] = ()
    denom: int = 1
    chroma: bool = False

    def __post_init__(self):
        if self.denom < 1:
            raise MalformedError("a denominator must be 1 or more")
        if self.dest < 0 or any(src < 0 for src, _ in self.factors):
            raise MalformedError("channels are numbered from 0")

    @property
    def mixes(self) -> bool:
        return bool(self.factors) or self.denom > 1


@dataclass(frozen=True)
class Program:
    """An ordered list of channel mixes."""

    mixes: tuple[Mix, ...] = field(default_factory=tuple)

    def then(self, dest: int, *factors: tuple[int, int], denom: int = 1, chroma: bool = False) -> Program:
        return Program((*self.mixes, Mix(dest, tuple(factors), denom, chroma)))

    def __iter__(self) -> Iterator[Mix]:
        return iter(self.mixes)

    def mixed_channels(self) -> set[int]:
        return {m.dest for m in self.mixes if m.mixes}

    def chroma_flags(self, channels: int) -> list[bool]:
        flags = [False] * channels
        for m in self.mixes:
            self._within(m, channels)
            flags[m.dest] = m.chroma
        return flags

    @staticmethod
    def _within(m: Mix, channels: int) -> None:
        if m.dest >= channels or any(src >= channels for src, _ in m.factors):
            raise MalformedError("a mix refers to a channel that the image lacks")

    def to_bytes(self) -> bytes:
        out = BitWriter()
        for m in self.mixes:
            numbers = [m.dest, *(n for pair in m.factors for n in pair), -1, m.denom, int(m.chroma)]
            for n in numbers:
                write_signed(out, n, 2)
        write_signed(out, -1, 2)
        return out.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes, channels: int) -> tuple[Program, int]:
        """The program at the start of ``data`` and the number of bytes it takes."""
        bits, mixes = BitReader(data), []
        while (dest := read_signed(bits, 2)) >= 0:
            factors = []
            while (src := read_signed(bits, 2)) >= 0:
                factors.append((src, read_signed(bits, 2)))
            denom, chroma = read_signed(bits, 2), read_signed(bits, 2)
            mix = Mix(dest, tuple(factors), denom, bool(chroma))
            cls._within(mix, channels)
            mixes.append(mix)
        return cls(tuple(mixes)), bits.words_used() * 4

    @classmethod
    def yuv444(cls) -> Program:
        """Channels 1 and 2 are chroma; nothing is mixed."""
        return cls().then(1, chroma=True).then(2, chroma=True)

    @classmethod
    def uyv(cls) -> Program:
        """RGB to difference channels around a luma in the green channel."""
        return cls().then(0, (1, -1), chroma=True).then(2, (1, -1), chroma=True).then(1, (0, 1), (2, 1), denom=4)

    @classmethod
    def a710(cls, red: int, blue: int) -> Program:
        """The A710 transform for the given places of red and blue; green is channel 1."""
        out = cls().then(red, (1, -1), chroma=True).then(blue, (1, -2), (red, -1), denom=2, chroma=True)
        return out.then(1, (blue, 2), (red, 3), denom=8)

    @classmethod
    def a710_bgr(cls) -> Program:
        return cls.a710(red=2, blue=0)

    @classmethod
    def a710_rgb(cls) -> Program:
        return cls.a710(red=0, blue=2)
