"""Every registered query with a DuckDB statement against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from examloom.plans import catalog
from examloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: These parse packages in Python workers and run longest; the driver compares them at the next size.
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v == int(v) else v

    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    cols, got = rows(QUERIES[name](spark, SF).toPandas())
    want_cols, want = rows(duck.sql(ORACLES[name]).df())
    assert cols == want_cols and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_crop_attribution_takes_whole_tables(duck):
    """Each line and each order is in the range join, on pages of at most 16 units."""
    for sql, name in ((catalog.OPS, "lineitem"), (catalog.BANDS, "orders")):
        assert duck.sql(f"SELECT count(*) FROM ({sql})").fetchall() == duck.sql(f"SELECT count(*) FROM {name}").fetchall()
    assert duck.sql(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({catalog.BANDS}) GROUP BY page)").fetchall()[0][0] <= 16
