"""Every registered query against its DuckDB statement, on the supplied tables."""

import os

import duckdb
import pandas as pd
import pytest

from rasterloom import catalog

DATA = os.environ.get("RASTERLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tidy(rows: pd.DataFrame) -> list[tuple]:
    rows = rows[sorted(rows.columns)].astype(object).where(rows.notna(), None)
    return sorted((tuple(map(repr, r)) for r in rows.itertuples(index=False)))


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers of any width are one type; a column with nulls keeps whole numbers."""
    return rows.apply(lambda s: s.map(lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v).astype(object))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name]).df()
    mine = got.toPandas()
    assert sorted(mine.columns) == sorted(want.columns)
    assert len(mine) == len(want)
    assert tidy(plain(mine)) == tidy(plain(want))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
