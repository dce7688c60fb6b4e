"""The registered queries over the smallest tables: a row per document or page, and DuckDB's rows where SQL can tell them."""

import os

import duckdb
import pytest
from examloom.llm import queries, sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
PER_ROW = {"op1_sharding": "documents", "op2_near_duplicates": "documents", "op4_token_files": "documents", "op5_byte_bpe": "documents", "op6_toxicity": "documents", "op7_quality_rules": "documents", "op8_line_dedup": "documents", "op9_warc": "pages", "op10_url_filters": "pages"}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each(spark, name):
    got = queries.QUERIES[name](spark, SF)
    key = got.columns[0]
    ids = [r[key] for r in got.select(key).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT {key} FROM '{SF}/{PER_ROW[name]}.parquet'").fetchall()]
    assert sorted(ids) == sorted(want)


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def test_leaks_are_whole_items(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r for r in queries.op3_decontamination(spark, SF).collect()}
    assert want <= set(got) and all(got[k].edits == 0 and docs[k[0]][got[k].start : got[k].end] == items[k[1]] for k in want)
