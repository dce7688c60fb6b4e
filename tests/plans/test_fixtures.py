"""Projections do not depend on the order of the files' rows."""

import datetime

import pytest
from examloom.plans.catalog import QUERIES

LINES = [(1, 20, 12, 1), (1, 20, 6, 1), (1, 376, 1, 2), (1, 526, 1, 2)]  # order, part, supplier, line: the pairs share a place, not box or style


@pytest.mark.parametrize("name", ["detect_questions", "label_dedup", "atom_classes"])
def test_equal_places_fall_the_same_way(spark, tmp_path, name):
    day = datetime.datetime(2020, 1, 1)
    got = []
    for way in (1, -1):
        folder = f"{tmp_path}/{way}"
        spark.createDataFrame([(1, 1, "O", 1.0, day, "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
        rows = [(*x, 5.0, 1.0, 0.0, 0.01, "N", "O", day) for x in LINES[::way]]
        schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        got.append(sorted(map(tuple, QUERIES[name](spark, folder).collect())))
    assert got[0] == got[1] and len(got[0]) > 1
