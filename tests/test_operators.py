"""The column paths against the array kernels, containers at rest, damage, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import bits, blocks, container, kernels
from rasterloom.operators import channels, codec, codes, compare, context, headers, lattice, layout, lifting, progressive, quant, turbo
from rasterloom.plans import lossy
from rasterloom.sources import containers
from rasterloom.spec import Program, Spec
from rasterloom.streaming import prefixes

SHAPES = [(1, 1), (1, 9), (9, 1), (8, 8), (7, 9)]


def cells_of(spark, planes: np.ndarray, name: str = "v"):
    """(image, channel, h, w) to long rows."""
    rows = [(int(i), int(c), int(y), int(x), int(planes[i, c, y, x])) for i, c, y, x in np.ndindex(*planes.shape)]
    return spark.createDataFrame(rows, f"image_id bigint, c int, y int, x int, {name} int")


def array_of(cells, like: np.ndarray, name: str = "v") -> np.ndarray:
    out = np.full(like.shape, -9999)
    for r in cells.collect():
        out[r.image_id, r.c, r.y, r.x] = r[name]
    return out


def noise(shape, seed=0, low=0, high=256):
    return np.random.default_rng(seed).integers(low, high, shape)


@pytest.mark.parametrize("kind", ["linear", "cubic"])
@pytest.mark.parametrize("shape", SHAPES)
def test_windows_equal_arrays(spark, kind, shape):
    h, w = shape
    raw = noise((2, 1, h, w))
    spec = Spec(w, h, filter=kind)
    lifted = lifting.lift_windows(cells_of(spark, raw), spec)
    want = np.stack([[kernels.lift(p[0], kind)] for p in raw])
    assert (array_of(lifted, raw) == want).all()
    assert (array_of(lifting.unlift_windows(cells_of(spark, want), spec), raw) == raw).all()
    assert (array_of(lifting.lift(cells_of(spark, raw), spec), raw) == want).all()
    assert (array_of(lifting.unlift(cells_of(spark, want), spec), raw) == raw).all()


def test_window_passes_share_one_exchange(spark):
    cells = cells_of(spark, noise((2, 2, 4, 4)))
    plan = lifting.lift_windows(cells, Spec(4, 4, 2), levels=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("shape", SHAPES)
def test_quantisation_columns(spark, shape):
    h, w = shape
    raw = noise((1, 2, h, w), 3, -2000, 2000)
    spec = Spec(w, h, 2, quality=124)
    got = quant.quantize(cells_of(spark, raw), spec, chroma=[1])
    want = np.stack([kernels.quantize(raw[0, 0], 124, 0, 8192), kernels.quantize(raw[0, 1], spec.chroma_quality, 0, 8192)])[None]
    assert (array_of(got, raw) == want).all()
    back = quant.dequantize(got, spec, chroma=[1])
    want = np.stack([kernels.dequantize(want[0, 0], 124, 0, 8192), kernels.dequantize(want[0, 1], spec.chroma_quality, 0, 8192)])[None]
    assert (array_of(back, raw) == want).all()


@pytest.mark.parametrize("quality", [30, 1024])
@pytest.mark.parametrize("shape", [(1, 1), (9, 1), (5, 13)])
def test_turbo_columns_equal_blocks(spark, quality, shape):
    h, w = shape
    raw = noise((1, 2, h, w), 4, -3, 4)
    spec = Spec(w, h, 2, quality=quality, block_size=2, encoder="turbo")
    got = {(r.level_step, r.c, r.block_y, r.block_x): bytes.fromhex(r.words) for r in turbo.block_words(cells_of(spark, raw), spec, [1]).collect()}
    want = {}
    for k, step in enumerate(spec.steps()):
        for c, by, bx, ys, xs in container.block_windows(spec, step):
            q = container.quality_of(spec, c == 1)
            want[step, c, by, bx] = blocks.encode_block(raw[0, c, ys, xs], step, "turbo", q, k == 0 and not by and not bx, c == 1)
    assert got == want


@pytest.mark.parametrize("block_size", [2, 4])
def test_context_columns_equal_blocks(spark, block_size):
    h, w = 19, 23
    raw = noise((1, 1, h, w), 5, -300, 300)
    spec = Spec(w, h, block_size=block_size)
    got = {(r.level_step, r.y, r.x): (r.first, r.second) for r in context.context_moments(cells_of(spark, raw), spec).collect()}
    want = {}
    for step in spec.steps():
        for _, by, bx, ys, xs in container.block_windows(spec, step):
            window = raw[0, 0, ys, xs].tolist()
            for y, x in blocks.cells(len(window), len(window[0]), step):
                want[step, y + ys.start, x + xs.start] = blocks.around(window, y, x, step)
    assert got == want


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (9, 14), (16, 16)])
def test_context_plan_equals_one_cell_at_a_time(shape):
    h, w = shape
    for step in (1, 2, 4):
        places, weights, n = blocks.context_plan(h, w, step)
        for k, (y, x) in enumerate(blocks.cells(h, w, step)):
            want = sorted((r * w + c, m) for r, c, m in blocks.context_cells(y, x, step, h, w))
            assert sorted((p, m) for p, m in zip(places[k].tolist(), weights[k].tolist()) if m) == want and n[k] == sum(m for _, m in want)


def test_code_columns(spark):
    values = [*range(-40, 40), -255, 255, 4000, -4000, 60_000, -60_000]
    rows = spark.createDataFrame([(v,) for v in values], "x int")
    for pot in range(5):
        got = rows.select("x", F.expr(codes.signed_code("x", pot)).alias("s"), F.expr(codes.interleaved_code("x", pot)).alias("i")).collect()
        assert all(r.s == bits.signed_bits(r.x, pot) and r.i == bits.interleaved_bits(r.x, pot) for r in got)


@pytest.mark.parametrize("program", [Program(), Program.uyv(), Program.a710_bgr(), Program.a710_rgb()])
def test_channel_columns(spark, program):
    raw = noise((1, 3, 4, 5), 6)
    wide = channels.to_wide(cells_of(spark, raw, "sample"), 3)
    mixed = channels.mix_forward(wide, program, 3, 8)
    assert (array_of(channels.to_long(mixed, 3), raw) == container.mix_forward(program, raw[0], 8)[None]).all()
    back = channels.mix_back(channels.mix_forward(wide, program, 3, 8, True), program, 3, 8, True)
    assert (array_of(channels.to_long(back, 3, "raw", "v"), raw) == raw).all()


def test_interleaving_with_layers(spark):
    spec = Spec(2, 3, 2, layers=2)
    raw = noise((1, 4, 3, 2), 7)
    flat = layout.to_interleaved(cells_of(spark, raw, "sample"), spec)
    assert bytes(r.sample for r in flat.orderBy("pos").collect()) == container.planes_to_interleaved(raw[0], 2)
    assert (array_of(layout.to_planar(flat, spec), raw) == raw).all()
    some = layout.to_planar(flat, spec, boost=2, skip={1, 2})
    assert sorted({r.c for r in some.collect()}) == [0, 1]
    full = layout.fill_interleaved(flat.withColumn("sample", F.lit(255)), some, spec, boost=2, skip={1, 2})
    want = np.where(np.isin(np.arange(4), [1, 2])[None, :, None, None], 255, raw)
    assert bytes(r.sample for r in full.orderBy("pos").collect()) == container.planes_to_interleaved(want[0], 2)


def test_block_numbers(spark):
    spec = Spec(13, 7, 2, block_size=2)
    rows = lattice.with_blocks(cells_of(spark, noise((1, 2, 7, 13))), spec).where("(x | y) > 0").collect()
    for step in spec.steps():
        order = [(c, by, bx) for c, by, bx, _, _ in container.block_windows(spec, step)]
        assert all(order[r.block_index] == (r.c, r.block_y, r.block_x) for r in rows if r.level_step == step)


@pytest.mark.parametrize("encoder", ["turbo", "fast", "contextual"])
def test_blocks_at_rest(spark, tmp_path, encoder):
    """Block rows make the same payload as whole images; downsampled reads skip the finer partitions."""
    raw = noise((2, 2, 9, 14), 8)
    spec = Spec(14, 9, 2, block_size=2, encoder=encoder)
    containers.write_blocks(codec.encode_blocks(cells_of(spark, raw), spec), str(tmp_path / "b"))
    coded = containers.read_blocks(spark, str(tmp_path / "b"))
    assert (array_of(codec.decode_blocks(coded, spec), raw) == raw).all()
    payloads = {r.image_id: bytes(r.bytes) for r in codec.assemble(coded).collect()}
    assert payloads == {i: container.encode_planes(spec, raw[i], [False] * 2) for i in range(2)}
    small = containers.read_blocks(spark, str(tmp_path / "b"), 1)
    assert "PartitionFilters: [isnotnull(level_step" in small._jdf.queryExecution().executedPlan().toString()
    low = codec.decode_blocks(small, spec, downsampling=1)
    want = np.stack([[kernels.lift(p, "linear", 1)[::2, ::2] for p in image] for image in raw])
    assert (array_of(low, want) == want).all()


def test_files_and_damage(spark, tmp_path):
    """A container that can't be read gets a status; the others are read."""
    raw = noise((1, 3, 6, 5), 9)
    spec = Spec(5, 6, 3, chroma_scale=1)
    made = codec.encode_rasters(cells_of(spark, raw, "sample"), spec, Program.uyv()).collect()[0]
    good = bytes(made.bytes)
    for name, data in {"a": good, "b": good[:20], "c": b"x" * 40, "d": good[: len(good) // 2]}.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    rows = containers.read_files(spark, str(tmp_path / "*.bin"))
    decoded = codec.decode_rasters(rows).join(rows.select("image_id", "path"), "image_id").collect()
    status = {r.path[-5]: r.status for r in decoded}
    assert status["a"] == "ok" and status["b"] == status["c"] == "HeaderError" and status["d"] in ("ok", "UnderflowError")
    assert {r.c: r.v for r in decoded if r.path.endswith("a.bin")} == {c: raw[0, c].ravel().tolist() for c in range(3)}
    tested = {r.path[-5]: r.status for r in codec.check_containers(rows).join(rows, "image_id").collect()}
    assert tested["a"] == "ok" and tested["b"] == "HeaderError"


def test_every_prefix(spark):
    """The plan over block sizes finds what the reader of bytes finds, for each prefix length."""
    raw = noise((1, 1, 6, 11), 10, 0, 30)
    spec = Spec(11, 6, block_size=2, encoder="turbo")
    payload = container.encode_planes(spec, raw[0], [False])
    words = turbo.block_words(cells_of(spark, np.stack([[kernels.lift(raw[0, 0], "linear")]])), spec).cache()
    for d in (0, 1):
        for got in progressive.points_of_interest(words, spec, range(0, len(payload) + 4, 3), d).collect():
            n = got.prefix
            try:
                want = (container.point_of_interest(spec, payload[:n], d)[0], "ok")
            except container.UnderflowError:
                want = (None, "underflow")
            assert (got.point_of_interest, got.status) == want, (d, n)


def test_headers(spark):
    rows = spark.createDataFrame([("00" * 32,), ("4746",), (Spec(7, 9, 3, intent="bgr").to_bytes().hex().upper(),)], "header string")
    got = {r.status: r for r in headers.parse_headers(rows).collect()}
    assert set(got) == {"magic", "short", "ok"} and got["ok"].width == 7 and got["ok"].intent == "bgr"


def test_compare(spark):
    a = cells_of(spark, noise((1, 1, 3, 3)), "sample")
    assert compare.differences(a, a).collect()[0].equal
    fewer = compare.differences(a, a.where("x < 2")).collect()[0]
    assert fewer.different == 3 and not fewer.equal


def test_empty(spark):
    """No rows in, no rows out, of every operator on cells."""
    none = spark.createDataFrame([], "image_id bigint, c int, y int, x int, v int")
    spec = Spec(8, 8)
    for out in (
        lifting.lift(none, spec), lifting.unlift_windows(none, spec), quant.quantize(none, spec), turbo.block_words(none, spec),
        context.context_moments(none, spec), codec.encode_blocks(none, spec), codec.encode_rasters(none.withColumnRenamed("v", "sample"), spec),
        lossy.low_pass(none.withColumnRenamed("v", "sample"), spec, 1),
    ):
        assert out.count() == 0


def test_stream_of_prefixes(spark, tmp_path):
    """Pieces in the wrong order: the finest complete level only ever gets finer, and ends at 1."""
    raw = noise((1, 1, 12, 12), 11)
    spec = Spec(12, 12, encoder="turbo")
    payload = container.encode_planes(spec, raw[0], [False])
    cut = [(k, payload[k : k + 9]) for k in range(0, len(payload), 9)]
    pieces = [cut[0], *reversed(cut[1:])]
    for k, (at, data) in enumerate(pieces):
        spark.createDataFrame([(1, at, bytearray(data))], "image_id bigint, offset bigint, bytes binary").write.mode("append").parquet(str(tmp_path / "in" / f"{k:03}"))
    stream = spark.readStream.schema("image_id bigint, offset bigint, bytes binary").parquet(str(tmp_path / "in" / "*"))
    query = prefixes.progress(stream, spec).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.sql("select * from seen order by have").collect()
    assert rows[-1].finest_step == 1 and rows[-1].point_of_interest == 0 and rows[-1].have == len(payload)
