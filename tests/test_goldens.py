"""Fixed vectors that any implementation of the container format must reproduce."""

import numpy as np
import pytest

from rasterloom.errors import HeaderError, MalformedError, UnderflowError
from rasterloom.functions import bits as B
from rasterloom.functions import blocks, container, kernels
from rasterloom.spec import Program, Spec

#: 10 x 8 digits: cell (y, x) holds (x + y + 1) % 10.
DIGITS = np.add.outer(np.arange(1, 9), np.arange(10)) % 10

# --- fixed values -----------------------------------------------------------
LIFTED = {
    "cubic": """
        1 0 0 0 1 0 1 0 6 -9 0 0 0 0 0 -1 1 8 -2 5 0 0 0 0 2 1 7 -2 -2 2 0 0 0 -1 1 8 -3 3 1 0
        4 0 1 1 2 -2 -3 0 -5 1 0 0 1 8 -3 3 1 0 0 0 2 0 4 -1 -6 1 7 0 5 1 1 6 -7 6 2 -1 1 0 1 0""",
    "linear": """
        1 0 0 0 1 0 1 0 6 -9 0 0 0 0 0 0 2 7 -2 5 0 0 0 0 2 1 7 -3 -2 2 0 0 0 0 2 7 -3 2 1 0
        4 0 1 1 2 -3 -2 0 -5 1 0 0 2 7 -3 2 1 0 0 0 2 1 3 -2 -6 0 6 0 4 1 1 5 -7 5 2 0 1 0 1 0""",
}
QUANT_IN = """
    1 0 254 0 33 0 225 0 198 247 0 0 1 0 43 127 6 120 187 133 0 0 64 35 8 29 143 55 52 34
    0 0 43 127 226 10 148 115 225 0 4 35 59 37 161 22 100 28 245 1 0 127 222 10 155 131 229 0 1 0
    2 36 128 254 3 101 225 0 57 1 1 6 123 6 194 255 1 0 1 0"""
QUANT_OUT = """
    1 0 31 0 8 0 28 0 198 15 0 0 0 0 2 7 0 7 11 8 0 0 8 2 1 1 17 3 6 2 0 0 2 7 14 0 9 7 14 0
    1 2 7 2 40 1 12 1 61 0 0 7 13 0 9 8 14 0 0 0 0 2 16 15 0 6 28 0 7 0 0 0 7 0 12 15 0 0 0 0"""
DEQUANT_IN = """
    1 0 254 0 33 0 225 0 198 247 0 1 0 43 127 6 120 187 133 0 0 64 35 8 29 143 55 52 34 0
    0 43 127 226 10 148 115 225 0 0 35 59 37 161 22 100 28 245 1 0 127 222 10 155 131 229 0 1 0 0
    36 128 254 3 101 225 0 57 1 0 6 123 6 194 255 1 0 1 0 0"""
DEQUANT_OUT = """
    1 0 2036 0 134 0 1804 0 198 3960 0 24 0 696 2040 104 1928 3000 2136 0 0 1032 284 136 236 2296 444 840 276 0
    0 696 2040 3624 168 2376 1848 3608 0 0 142 952 300 2584 90 1608 228 3928 6 0 2040 3560 168 2488 2104 3672 0 24 0 0
    292 2056 2036 56 812 3608 0 920 12 0 104 1976 104 3112 4088 24 0 24 0 0"""
WRITTEN = "244 23 0 0 2 0 126 0 58 0 0 160 0 160 4 0 0 230 80 13 0 32 121 14"
READ = "0 0 223 1 0 37 0 93 162 128 29 0 0 122 208 1 0 0 0 39"
UNSIGNED = """0 0 16 0 0 38 0 92 0 16 54 0 224 1 0 18 10 0 54 0 32 6 0 130 2 0 57 0 5 0 5 108 0 34 0 160 113 0 84 2 0 158 0 176"""
INTERLEAVED = """80 1 0 0 0 68 0 0 0 0 128 15 3 0 192 123 0 220 0 80 0 63 2 0 192 152 0 0 9 0 72 2 13 0 5 224
    128 76 0 160 74 0 8 5 1 252 3 128 46 0 124 80 0 128 10 224"""
INTERLEAVED_READ = """0 64 5 0 4 0 0 240 76 0 0 24 0 0 14 0 32 2 0 30 31 0 102 0 12 0 5 0 24 174 0 128 0 128 29 0
    48 13 0 130 4 0 146 0 0 137 14 80"""
SIGNED = """48 3 0 0 0 49 0 0 64 133 0 0 0 192 15 0 154 0 0 202 0 56 2 0 248 4 0 83 0 192 63 0 40 4 128 66
    249 0 48 1 174 2 192 134 0 120 1 102 0 72 97 64"""
SIGNED_READ = """147 0 0 0 128 21 0 192 1 0 224 4 168 2 0 8 0 40 2 0 4 1 96 10 0 224 31 0 240 14 0 199 1 160 17 0
    0 116 0 255 131 1 96 63 2 176 3 86 0 64 11 240"""
BLOCKS = {
    ("turbo", False, False): """3 28 56 156 224 224 112 220 128 3 28 112 128 3 135 63 3 7 135 123 1 28 224 128 192 129 227 252
        192 129 195 61 254 0 14 112 128 131 195 113 128 3 135 123 142 243 7 112 3 14 28 28""",
    ("turbo", True, True): """112 224 112 142 131 195 113 15 14 112 192 129 14 28 254 0 28 28 238 1 112 128 3 14 7 142 243 7
        7 14 247 0 3 56 192 1 14 14 199 249 14 28 238 1 206 31 192 1 56 112 112 56 0 0 0 12""",
    ("fast", True, False): """4 64 64 140 24 51 39 0 97 192 192 96 59 143 115 101 22 142 226 148 119 30 167 94 47 151 163 56
        220 121 148 171 171 47 151 227 0 128 226 148""",
    ("contextual", False, False): """171 195 183 238 117 122 109 165 75 87 248 218 89 98 242 90 182 198 241 173 163 158 152 188
        239 140 227 43 202 168 39 78 0 0 128 118""",
    ("contextual", True, True): """14 223 186 143 233 181 149 174 93 225 107 215 137 201 107 45 26 199 183 102 122 98 242 218
        51 142 175 140 163 158 56 189 0 0 218 41""",
}
SHIFTED = {"turbo": "195 57 206 223 192 224 112 156", "contextual": "212 198 106 159 0 0 0 101"}
PAYLOADS = {
    (124, "linear", "contextual"): """1 0 0 0 1 0 0 0 1 0 0 0 0 76 0 128 0 64 28 2 16 7 8 0 1 0 0 0 1 0 0 0 1 0 0 0 0 32 96 128 0 224 228 137
        0 128 228 136 1 0 0 0 1 0 0 0 2 0 0 0 0 0 0 162 0 0 0 162 88 192 0 236 0 0 0 20 1 0 0 0 1 0 0 0 2 0 0 0
        0 0 192 133 0 0 192 133 149 213 184 153 0 0 112 216""",
    (512, "cubic", "turbo"): """1 0 0 0 1 0 0 0 1 0 0 0 0 0 12 128 0 24 16 2 6 4 8 0 2 0 0 0 2 0 0 0 1 0 0 0 0 24 2 128 0 0 0 33
        0 24 2 128 0 0 0 33 128 0 32 134 1 0 0 0 1 0 0 0 3 0 0 0 192 243 60 2 192 243 60 2 104 188 87 106 3 192 62 0
        192 62 0 236 1 0 0 0 1 0 0 0 4 0 0 0 0 0 6 0 0 0 6 0 1 89 11 0 193 1 14 224 128 5 44 96 0 128 0 147""",
}
PROGRAM = "183 119 85 151 246 114 119 85 0 128 50 233"
IMAGE = """71 70 87 88 1 0 0 0 12 0 0 0 8 0 0 0 2 0 0 0 229 96 15 7 0 2 0 0 0 0 0 0 183 119 85 151 246 114 119 85 0 128 50 233
    1 0 0 0 1 0 0 0 1 0 0 0 0 0 0 194 160 58 0 196 0 0 0 198 1 0 0 0 2 0 0 0 1 0 0 0 0 0 0 204 208 54 0 128
    0 0 176 1 0 0 0 204 1 0 0 0 3 0 0 0 1 0 0 0 0 0 0 162 161 80 56 198 78 228 244 1 0 0 0 44 0 0 0 162
    2 0 0 0 4 0 0 0 1 0 0 0 142 1 182 138 0 0 0 64 128 203 213 138 17 0 68 2 86 128 21 48 0 0 80 1 0 0 192 133"""
CUT = """2 0 0 0 1 0 0 0 1 0 0 0 7 0 0 128 0 0 0 28 160 58 0 196 168 16 0 66 2 0 0 0 2 0 0 0 2 0 0 0 35 0 0 128
    232 0 0 64 212 54 0 128 0 0 176 1 212 94 0 128 0 0 128 21 3 0 0 0 3 0 0 0 3"""
CUT_FIRST_ROW = "0 25 50 75 101 126 151 176 202 202 202 202"
HEADER = "71 70 87 88 1 0 0 0 128 7 0 0 56 4 0 0 3 0 0 0 5 224 127 7 8 2 0 0 0 0 0 0"
MIXED = "-48 -48 -48 32 32 32 36 44 52 20 28 36 -32 -32 -32 48 48 48"
# ----------------------------------------------------------------------------


def ints(text: str) -> list[int]:
    return [int(n) for n in text.split()]


def plane(text: str) -> np.ndarray:
    return np.array(ints(text)).reshape(8, 10)


def ramp(n: int = 288) -> bytes:
    return bytes(i % 256 for i in range(n))


def test_cubic_kernel():
    got = kernels.cubic(*np.array([(255, 0, 0, 255), (128, 0, 84, 32), (250, 10, 12, 243)]).T)
    assert got.tolist() == [0, 37, 10]


@pytest.mark.parametrize("kind", ["linear", "cubic"])
def test_lifting(kind):
    assert (kernels.lift(DIGITS, kind) == plane(LIFTED[kind])).all()
    assert (kernels.unlift(plane(LIFTED[kind]), kind) == DIGITS).all()


def test_quantisation():
    assert (kernels.quantize(plane(QUANT_IN), 512, 0, 8192) == plane(QUANT_OUT)).all()
    assert (kernels.dequantize(plane(DEQUANT_IN), 512, 0, 8192) == plane(DEQUANT_OUT)).all()


def test_bit_writer():
    out = B.BitWriter()
    for value, n in [(185 << 3 | 61, 30), (63, 17), (42, 21), (29, 27), (37, 20), (213, 25), (230, 12), (115, 19), (201, 8)]:
        out.put(value, n)
    assert list(out.to_bytes()) == ints(WRITTEN)
    small = B.BitWriter(limit=7)
    small.put(185, 32)
    small.put(3, 6)
    with pytest.raises(UnderflowError):
        small.to_bytes()


def test_bit_reader():
    bits = B.BitReader(bytes(ints(READ)))
    assert [bits.get(n) for n in (15, 2, 24, 17, 23, 15, 1, 11, 13, 17)] == [239, 2, 186, 148, 59, 162, 0, 29, 244, 156]
    bits = B.BitReader(bytes([1, 2, 3, 4, 5, 6]))
    bits.get(32)
    with pytest.raises(UnderflowError):
        bits.get(4)


def test_zero_runs():
    bits = B.BitReader(bytes([0b11110001, 0b10000001, 0b00101100, 0b10001000]))
    assert [bits.zeros(n) for n in (11, 1, 5, 6, 2, 2, 3, 10, 2, 2, 2, 2, 5)] == [0, 1, 2, 5, 1, 0, 2, 6, 0, 0, 0, 0, 3]


def _codes(write, numbers):
    out = B.BitWriter()
    out.parts = [write(n, k // 4) for k, n in enumerate(numbers)]
    return list(out.to_bytes())


def _numbers(read, text):
    bits = B.BitReader(bytes(ints(text)))
    return [read(bits, k // 4) for k in range(20)]


def test_codes():
    assert _numbers(B.read_unsigned, UNSIGNED) == [11, 163, 15, 135, 8, 92, 116, 78, 68, 12, 82, 226, 251, 58, 148, 232, 234, 172, 27, 252]
    own = [97, 79, 30, 222, 151, 24, 236, 254, 29, 128, 21, 47, 189, 65, 59, 176, 75, 48, 156, 75]
    assert _codes(B.interleaved_bits, own) == ints(INTERLEAVED)
    back = [17, -29, -105, 64, -56, -106, -29, 38, -54, 23, -42, 68, -18, -102, -113, 90, -114, -106, 55, -25]
    assert _numbers(B.read_interleaved, INTERLEAVED_READ) == back
    own = [181, 180, 214, 123, 106, 190, 123, 33, 127, 175, 242, 50, 81, 217, 37, 139, 41, 135, 193, 68]
    assert _codes(B.signed_bits, own) == ints(SIGNED)
    back = [243, 97, 15, 140, 194, 186, 129, 24, 175, 147, 103, 246, 223, 78, 221, 161, 21, 125, 167, 134]
    assert _numbers(B.read_signed, SIGNED_READ) == back


def test_contexts():
    got = [blocks.moments([(v, k) for v, k in [(238, 4), (91, 1)]])]
    assert got == [((16 * 1043 + 2) // 5, (16 * 234857 + 2) // 5)]
    grid = (np.add.outer(np.arange(1, 6), np.arange(10)) % 10).tolist()

    def at(by, bx, x, y):  # blocks of 4 lattice cells at step 2: 8 cells a side
        return blocks.around([row[8 * bx : 8 * bx + 8] for row in grid[8 * by : 8 * by + 8]], 2 * y, 2 * x, 2)

    assert at(0, 0, 0, 0) == (16, 16)
    assert at(0, 1, 0, 0) == (144, 1296)


@pytest.mark.parametrize("key", list(BLOCKS))
def test_blocks(key):
    scheme, dc, chroma = key
    data = blocks.encode_block(DIGITS, 1, scheme, 0, dc, chroma)
    assert list(data) == ints(BLOCKS[key])
    coarser = kernels.level_steps(8, 10) != 1
    coarser[0, 0] = not dc
    back = np.where(coarser, DIGITS, 0)
    blocks.decode_block(data, back, 1, scheme, 0, dc, chroma)
    assert (back == DIGITS).all()


@pytest.mark.parametrize("scheme", list(SHIFTED))
def test_shifted_block(scheme):
    window = DIGITS[4:8, 4:8]  # the fifth window of four cells a side
    assert list(blocks.encode_block(window, 1, scheme, 0, False, False)) == ints(SHIFTED[scheme])


@pytest.mark.parametrize("key", list(PAYLOADS))
def test_payload(key):
    quality, kind, scheme = key
    spec = Spec(12, 8, 3, quality=quality, filter=kind, encoder=scheme, intent="rgb")
    flat = np.frombuffer(ramp(), np.uint8).reshape(3, 8, 12).astype(int)
    assert list(container.encode_planes(spec, flat, [False] * 3)) == ints(PAYLOADS[key])


def test_image():
    spec = Spec(12, 8, 3, quality=124)
    data = container.encode_image(spec, Program.uyv(), ramp())
    assert list(data) == ints(IMAGE)
    pixels, target = container.decode_image(data)
    off = np.abs(np.frombuffer(pixels, np.uint8).astype(int) - np.frombuffer(ramp(), np.uint8))
    assert target == 0 and off.max() == 25 and len(pixels) == 288
    assert list(pixels[:34]) == [*range(21), *range(20, 32), 29]


def test_program():
    assert list(Program.uyv().to_bytes()) == ints(PROGRAM)
    program, used = Program.from_bytes(bytes(ints(PROGRAM)), 3)
    assert program == Program.uyv() and used == 12 and program.chroma_flags(3) == [True, False, True]
    raw = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8]).reshape(3, 6)
    assert container.mix_forward(Program.uyv(), raw, 8).ravel().tolist() == ints(MIXED)
    with pytest.raises(MalformedError):
        Program.from_bytes(bytes(ints(PROGRAM)), 2)


def test_header():
    spec = Spec(1920, 1080, 4, chroma_scale=1, block_size=7, intent="rgba")
    assert list(spec.to_bytes()) == ints(HEADER)
    assert Spec.from_bytes(bytes(ints(HEADER))) == spec


@pytest.mark.parametrize(
    "bad",
    [{"width": 0}, {"height": 0}, {"width": 1 << 30}, {"height": 1 << 30}, {"quality": 0}, {"quality": 1025}, {"block_size": 1},
     {"block_size": 31}, {"chroma_scale": 0}, {"channels": 0}, {"layers": 0}, {"width": (1 << 30) - 1, "height": (1 << 30) - 1, "channels": 65536}],
)
def test_header_rejects(bad):
    with pytest.raises(HeaderError):
        Spec(**{"width": 4, "height": 4} | bad)


def test_bad_magic():
    with pytest.raises(HeaderError):
        Spec.from_bytes(bytes([72, *ints(HEADER)[1:]]))


def test_cut_container():
    spec = Spec(12, 8, 3, quality=124, intent="rgb")
    planes, target = container.decode_planes(spec, bytes(ints(CUT)), [False] * 3)
    assert target == 112 and planes[0, 0].tolist() == ints(CUT_FIRST_ROW)
    with pytest.raises(UnderflowError):
        container.decode_planes(spec, bytes(ints(CUT))[:20], [False] * 3)


def test_downsampled_reads_are_partial_lifts():
    rng = np.random.default_rng(1)
    for kind in ("linear", "cubic"):
        for d in (1, 2, 3):
            spec = Spec(50, 30, filter=kind, encoder="turbo")
            raw = rng.integers(0, 256, (1, 30, 50))
            low, target = container.decode_planes(spec, container.encode_planes(spec, raw, [False]), [False], d)
            assert target == 0 and (low[0] == kernels.lift(raw[0], kind, d)[:: 1 << d, :: 1 << d]).all()


@pytest.mark.parametrize("scheme", ["turbo", "fast", "contextual"])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (8, 8), (7, 9), (17, 33)])
def test_lossless_round_trip(scheme, shape):
    rng = np.random.default_rng(sum(shape))
    h, w = shape
    for raw in (rng.integers(0, 256, (4, h, w)), np.zeros((4, h, w), int), np.full((4, h, w), 255)):
        spec = Spec(w, h, 2, layers=2, encoder=scheme, chroma_scale=1, block_size=2, filter="cubic")
        program = Program().then(0, (1, -1), chroma=True)
        data = container.encode_image(spec, program, container.planes_to_interleaved(raw, 2))
        assert container.decode_image(data)[0] == container.planes_to_interleaved(raw, 2)
