"""The driver contract."""

import __spark_entry__ as entry


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert all(isinstance(s, str) and s.strip() for s in oracles.values())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "unit_no", "label", "para_idx", "role"] and df.count() > 0


def test_workers_can_import_the_package(spark):
    entry.queries()["equation_trees"](spark, entry.SMOKE).limit(1).collect()
    assert entry.ROOT in spark.sparkContext.environment["PYTHONPATH"]
