"""Image files, the command line and the data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.__main__ import main
from rasterloom.errors import MalformedError
from rasterloom.functions import container
from rasterloom.operators import codec
from rasterloom.sources import datasource, images
from rasterloom.spec import Program, Spec


def picture(h, w, n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n), np.uint8)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_maps(n):
    samples = picture(5, 7, n)
    assert (images.parse(images.write(samples)) == samples).all()


@pytest.mark.parametrize("bad", [b"", b"P6", b"P6\n2 2\n255\n123", b"P6 x 2 255 ", b"P3\n1 1\n255\n1", b"P7\nWIDTH 1\n", b"P6\n1 1\n65535\n123456", b"P7\nENDHDR\n"])
def test_bad_maps(bad):
    with pytest.raises(MalformedError):
        images.parse(bad)


def test_comments():
    assert images.parse(b"P5 # grey\n# two\n2 1\n255\n\x01\x02").ravel().tolist() == [1, 2]


@pytest.mark.parametrize("intent", [None, "rgb", "rgba", "bgr", "bgra"])
def test_intents(intent):
    data = images.write(picture(4, 6, 3))
    out = images.parse(images.decompress(images.compress(data, intent)))
    assert (out[:, :, :3] == images.parse(data)).all() and (out.shape[2] == 3 or (out[:, :, 3] == 255).all())


def test_command_line(tmp_path, capsys):
    a, b, c = (str(tmp_path / n) for n in ("a.ppm", "a.rl", "b.ppm"))
    samples = picture(20, 30, 3)
    open(a, "wb").write(images.write(samples))
    assert main(["compress", a, b, "-e", "contextual", "-f", "cubic", "--block-size", "3"]) == 0
    assert main(["decompress", b, c]) == 0 and main(["compare", a, c]) == 0
    assert main(["decompress", b, c, "-d", "1"]) == 0 and images.parse(open(c, "rb").read()).shape == (10, 15, 3)
    assert main(["compare", a, c]) == 1 and main(["compress", a, b, "-q", "0"]) == 2 and main(["decompress", a, c]) == 2
    assert "different" in capsys.readouterr().out


def test_batch_of_files(spark, tmp_path):
    sizes = [(3, 4, 1), (9, 5, 3), (8, 8, 4)]
    for k, s in enumerate(sizes):
        (tmp_path / f"{k}.map").write_bytes(images.write(picture(*s, k)))
    (tmp_path / "bad.map").write_bytes(b"nothing")
    made = images.compress_files(spark, str(tmp_path / "*.map"), encoder="fast")
    status = {r.path[-5]: r.status for r in made.collect()}
    assert status == {"0": "ok", "1": "ok", "2": "ok", "d": "MalformedError"}
    back = images.decompress_files(made.where("status = 'ok'")).collect()
    for r in back:
        k = int(r.path[-5])
        assert (images.parse(bytes(r.bytes)) == picture(*sizes[k], k)).all()


def test_data_source(spark, tmp_path):
    """All blocks come back; a filter on the level reaches the reader."""
    spec = Spec(21, 13, 2, block_size=2, encoder="turbo", chroma_scale=1)
    raw = {}
    for k in range(3):
        raw[k] = picture(13, 21, 2, k)
        (tmp_path / f"{k}.rl").write_bytes(container.encode_image(spec, Program(), raw[k].tobytes()))
    datasource.register(spark)
    rows = spark.read.format("rasterloom").option("suffix", ".rl").load(str(tmp_path))
    blocks = rows.withColumn("image_id", F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("bigint"))
    cells = codec.decode_blocks(blocks.select("image_id", "level_step", "c", "block_y", "block_x", "block_index", F.lit(0).alias("n_words"), "bytes"), spec).collect()
    assert len(cells) == 3 * 13 * 21 * 2 and all(raw[r.image_id][r.y, r.x, r.c] == r.v for r in cells)
    assert {r.level_step for r in rows.where("level_step >= 4").collect()} == {4, 8, 16}
    reader = datasource.ContainerReader({"path": str(tmp_path), "downsampling": "1"})
    list(reader.pushFilters([datasource.GreaterThanOrEqual(("level_step",), 4)]))
    assert {t[1] for p in reader.partitions() for t in reader.read(p)} == {4, 8, 16}


def test_many_mixes_in_a_head():
    program = Program()
    for k in range(300):
        program = program.then(k % 3, ((k + 1) % 3, 1), denom=1 + k)
    spec = Spec(4, 4, 3)
    data = container.encode_image(spec, program, bytes(48))
    assert container.open_container(data)[:2] == (spec, program) and len(data) > 300
