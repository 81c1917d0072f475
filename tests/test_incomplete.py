"""Images that the tables end within, and images with cells missing: against DuckDB, and back again."""

import os

import duckdb
import numpy as np
import pytest

from rasterloom import catalog
from rasterloom.functions import kernels
from rasterloom.operators import codec, lifting
from rasterloom.plans import lossy
from rasterloom.spec import Program, Spec

from .test_operators import array_of, cells_of, noise
from .test_oracles import DATA, plain, tidy

EMBEDDED = ["downsample_1", "downsample_2", "lift_cubic_full", "lift_linear_full", "roundtrip_blocks", "unlift_cubic_roundtrip", "unlift_linear_roundtrip"]
SHARING = ["quantize_q124", "dequantize_q124", "lossy_error_stats", "subband_rate", "roundtrip_turbo", "roundtrip_fast", "roundtrip_contextual", "container_status"]
GAPS = ["lift_cubic_full", "lift_linear_full", "roundtrip_blocks", "unlift_cubic_roundtrip", "unlift_linear_roundtrip", "quantize_q124", "lossy_error_stats", "roundtrip_fast"]


def cut(path, ends: bool) -> duckdb.DuckDBPyConnection:
    """The tables, ended within an image or, with gaps, without some rows; as files and as views."""
    kept = {"embeddings": "vec_id < 47", "events": "event_id < 737", "orders": "o_orderkey < 777", "lineitem": "true"}
    if not ends:
        kept |= {"embeddings": "vec_id < 47 and vec_id not in (3, 4, 26, 31)", "events": "event_id < 737 and event_id % 97 <> 95", "orders": "o_orderkey < 777 and o_orderkey % 89 <> 87"}
    con = duckdb.connect()
    for t, where in kept.items():
        con.execute(f"COPY (SELECT * FROM read_parquet('{DATA}/{t}.parquet') WHERE {where}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    found = {}
    for ends in (True, False):
        path = str(tmp_path_factory.mktemp("cut"))
        found[ends] = path, cut(path, ends)
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name,ends", [*((n, True) for n in EMBEDDED + SHARING), *((n, False) for n in GAPS)])
def test_query(spark, tables, name, ends):
    path, con = tables[ends]
    mine = catalog.queries()[name](spark, path).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert len(mine) == len(want) > 0
    assert tidy(plain(mine)) == tidy(plain(want))


@pytest.mark.parametrize("kind", ["linear", "cubic"])
def test_any_cells_come_back(spark, kind):
    h, w = 9, 13
    raw = noise((2, 2, h, w), 7)
    some = noise((2, 2, h, w), 8, 0, 3) > 0
    some[1, :, 6:] = some[1, :, :, 11:] = False
    cells = cells_of(spark, np.where(some, raw, -1)).where("v >= 0")
    spec, want = Spec(w, h, 2, filter=kind, block_size=2, encoder="fast"), np.where(some, raw, -9999)
    assert (array_of(lifting.unlift(lifting.lift(cells, spec, by_place=True), spec, by_place=True), raw) == want).all()
    assert (array_of(codec.decode_blocks(codec.encode_blocks(cells, spec), spec), raw) == want).all()
    back = lossy.round_trip(cells.withColumnRenamed("v", "sample"), spec, Program())
    assert (array_of(back, raw, "sample") == want).all()


def test_an_image_that_ends_early_is_a_smaller_container(spark):
    raw = noise((1, 1, 5, 13), 9)
    made = codec.encode_rasters(cells_of(spark, raw, "sample"), Spec(13, 9)).collect()[0]
    assert made.present is None and Spec.from_bytes(bytes(made.bytes)).height == 5


def test_nulls_stay_null():
    cells = kernels.plane_of(np.array([1.0, np.nan, 3.0, 4.0]), None, 1, 4)
    assert list(kernels.lift(cells, "linear").ravel()) == [1, None, None, 1]
