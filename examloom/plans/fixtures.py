"""Paper-shaped tables projected from the supplied star schema, in SQL that Spark and DuckDB read alike.

The supplied tables hold no word-processor files, so the registered queries run on projections: a customer is a paper, an order a
question or a table, a line item a paragraph, a line, a cell or a control.  The operators take any table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "embeddings", "benchmark", "labels", "conversations")

#: Common table expressions by name; later ones may read earlier ones.
CTES: dict[str, str] = {
    "raw_paragraphs": """
  SELECT o_custkey AS doc_id, o_orderkey * 10 AS node_id,
    CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 3 = 0 THEN '[' || CAST(o_orderkey % 45 + 1 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' ~ ' WHEN 1 THEN '～' WHEN 2 THEN '∼' ELSE ' ∽' END || CAST(o_orderkey % 45 + 3 AS STRING) || '] 다음 글을 읽고 물음에 답하시오.'
         WHEN o_orderkey % 11 = 0 THEN '\u3000' || CAST(o_orderkey % 45 + 1 AS STRING) || ' .' || chr(9) || '옳은 것은?'
         WHEN o_orderkey % 13 = 0 THEN '\u00a0' || CAST(o_orderkey % 120 + 1 AS STRING) || '. 값을 구하시오.'
         WHEN o_orderkey % 17 = 0 THEN CAST(o_orderkey % 45 + 1 AS STRING) || '.14 은 수이다.'
         WHEN o_orderkey % 19 = 0 THEN '99999999999. 넘침'
         WHEN o_custkey % 7 = 1 AND o_orderkey % 5 = 0 THEN '과학 탐구 ' || CAST(o_orderkey % 45 + 1 AS STRING)
         WHEN o_custkey % 7 = 2 AND o_orderkey % 5 = 0 THEN '수학' || chr(10) || '영역'
         WHEN o_custkey % 7 = 3 AND o_orderkey % 5 = 0 THEN '문화와 사회 현상'
         ELSE CAST(o_orderkey % 45 + 1 AS STRING) || '. 다음 중 옳은 것은?' END AS text,
    CAST(o_orderkey % 29 = 0 AS INT) * 255 AS first_color, CASE WHEN o_orderkey % 31 = 0 THEN 'XL12' WHEN o_orderkey % 31 = 1 THEN 'xlsx' ELSE '바탕글' END AS style_name,
    o_orderkey % 37 = 0 AS has_section_def, FALSE AS has_visual, 0 AS n_tables, 0 AS n_pictures, 0 AS n_equations, FALSE AS is_bogi, 0 AS table_rows, 0 AS table_cols, CAST(o_orderkey % 50 AS INT) AS para_shape_id, CAST(o_orderkey % 5 AS INT) AS style_id,
    CAST(CASE WHEN o_custkey % 23 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS section_idx
  FROM orders
  UNION ALL
  SELECT o_custkey, l_orderkey * 10 + l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN substr('①②③④⑤', CAST(l_linenumber % 5 + 1 AS INT), 1) || ' ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || CASE WHEN l_suppkey % 4 = 0 THEN chr(10) || '②' ELSE '' END
         WHEN l_partkey % 10 = 3 THEN '  '
         WHEN l_partkey % 10 = 4 THEN ''
         WHEN l_tax >= 0.07 THEN '그림과 같다. [4점]'
         WHEN l_partkey % 41 = 0 THEN '연구진 수정 사항'
         WHEN l_partkey % 10 = 5 THEN '* 낱말: 뜻'
         WHEN l_partkey % 10 = 6 THEN '“그래” 하고 말했다.'
         WHEN l_partkey % 10 = 7 THEN '(중략)'
         WHEN l_partkey % 10 = 8 THEN '= + 12'
         ELSE 'x' || chr(9) || '값 ' || CAST(l_partkey AS STRING) END,
    CAST(l_partkey % 43 = 0 AS INT) * 128, CASE WHEN l_partkey % 47 = 0 THEN 'xl' ELSE 'Normal' END, FALSE, l_suppkey % 3 = 0,
    CAST(l_suppkey % 6 = 0 AS INT), CAST(l_suppkey % 6 = 3 AS INT), CAST(l_suppkey % 6 = 4 AS INT), l_suppkey % 12 = 0 AND l_partkey % 2 = 0, CAST(l_partkey % 3 + 1 AS INT), CAST(l_suppkey % 2 + 1 AS INT), CAST(l_partkey % 50 AS INT), CAST(l_partkey % 5 AS INT),
    CAST(CASE WHEN o_custkey % 23 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "paragraphs": """
  SELECT *, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY node_id, text, para_shape_id, first_color, n_tables, n_pictures, n_equations, has_visual, table_rows, table_cols) - 1 AS para_idx FROM raw_paragraphs""",
    "line_segs": """
  SELECT l_orderkey AS para_id, l_orderkey % 500 AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seg,
    CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE CAST(l_linenumber * 1500 - CASE WHEN l_partkey % 7 = 0 THEN 4000 ELSE 0 END AS BIGINT) END AS vertical_pos,
    CAST(l_quantity AS BIGINT) * 20 AS line_height, CAST(l_quantity AS BIGINT) * 15 AS text_height, CAST(l_suppkey % 5 AS BIGINT) * 100 AS line_spacing, CAST(l_partkey % 3 AS BIGINT) * 700 AS column_start,
    CAST(l_suppkey % 3 AS BIGINT) * 8000 AS segment_width, CAST(l_linenumber * 12 AS BIGINT) AS text_start
  FROM lineitem""",
    "cells": """
  SELECT l_orderkey AS table_id, cell_idx, CAST(floor(cell_idx / 3) AS BIGINT) AS cell_row, cell_idx % 3 AS cell_col, 1 + CAST(l_partkey % 5 = 0 AS INT) AS row_span, 1 + CAST(l_suppkey % 4 = 0 AS INT) AS col_span,
    CAST(l_partkey % 9 AS BIGINT) * 500 AS width, CAST(l_suppkey % 7 AS BIGINT) * 300 AS height, CAST(l_partkey % 20 AS INT) AS border_fill_id, l_suppkey % 5 = 0 AS has_picture,
    CASE WHEN l_returnflag <> 'A' THEN substr('①②③④⑤', CAST(cell_idx % 5 + 1 AS INT), 1) ELSE '' END || CASE WHEN l_partkey % 8 = 0 THEN ' 보 기' ELSE ' 값' END AS text, CAST(l_quantity AS BIGINT) * 30 AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS cell_idx FROM lineitem) AS numbered""",
    "grids": """
  SELECT table_id, max(cell_row) + 1 AS row_count, CASE WHEN table_id % 4 = 0 THEN 5 ELSE 3 END AS col_count, CASE WHEN table_id % 6 = 0 THEN 0 ELSE 4000 + table_id % 1000 END AS box_height FROM cells GROUP BY table_id""",
    "controls": """
  SELECT o_custkey AS doc_id, node_id, kind, number_type, l_partkey % 60 AS bin_id, CAST(l_suppkey % 90 AS INT) AS z_order, l_suppkey % 3 = 0 AS treat_as_char, l_partkey AS width, l_linenumber AS new_number,
    CASE l_suppkey % 6 WHEN 0 THEN 'Square' WHEN 1 THEN 'Tight' WHEN 2 THEN 'Through' WHEN 3 THEN 'TopAndBottom' WHEN 4 THEN 'BehindText' ELSE 'InFrontOfText' END AS text_wrap, 'x ^{' || CAST(l_partkey AS STRING) || '} over ' || CAST(l_linenumber AS STRING) AS script
  FROM (SELECT o_custkey, lineitem.*, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS node_id,
      CASE l_partkey % 7 WHEN 0 THEN 'picture' WHEN 1 THEN 'equation' WHEN 2 THEN 'auto_number' WHEN 3 THEN 'auto_number' WHEN 4 THEN 'new_number' WHEN 5 THEN 'shape' ELSE 'table' END AS kind,
      CASE l_suppkey % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'footnote' WHEN 2 THEN 'picture' WHEN 3 THEN 'table' ELSE 'equation' END AS number_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS placed""",
    "bin_data": """
  SELECT p_partkey * 2 AS bin_id, CASE p_size % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'bmp' WHEN 3 THEN 'gif' ELSE 'wmf' END AS ext, p_name AS data, CASE WHEN p_size % 9 = 0 THEN 'Link' ELSE 'Embedding' END AS data_type FROM part""",
    "fields": """
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ClickHere' WHEN 1 THEN 'Memo' ELSE 'Hyperlink' END AS kind,
    CASE WHEN event_id % 3 = 1 THEN 'MEMO/' || event_type || '/' || CAST(event_id AS STRING) || '/x'
         ELSE 'Clickhere:set:9:Direction:wstring:3:' || event_type || CASE WHEN event_id % 2 = 0 THEN ' HelpState:wstring:2: m' || CAST(user_id AS STRING) || ' ' ELSE ' HelpState:wstring:0: ' END || CASE WHEN event_id % 5 < 2 THEN ' Name:wstring:4:n ' || CAST(event_id AS STRING) || ' ' ELSE '' END END AS command,
    CASE WHEN event_id % 7 = 0 THEN 'named' WHEN event_id % 7 = 1 THEN '' END AS data_name, event_id % 4 AS properties
  FROM events""",
}


def needed(names: list[str]) -> list[str]:
    """The expressions that ``names`` read, in order."""
    out: set[str] = set()

    def add(n: str) -> None:
        if n in CTES and n not in out:
            for other in CTES:
                if other != n and f" {other}" in CTES[n].replace("(", " ").replace("\n", " "):
                    add(other)
            out.add(n)

    for n in names:
        add(n)
    return [n for n in CTES if n in out]


def with_fixtures(sql: str, *names: str) -> str:
    """``sql`` (a SELECT, or further expressions after a comma and a SELECT) over the named projections."""
    recursive = "RECURSIVE " * ("steps AS" in sql or "placed AS (SELECT doc_id" in sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed(list(names)))
    return f"WITH {recursive}{head}{sql}" if sql.lstrip().startswith(",") else f"WITH {recursive}{head}\n{sql}"


#: The order of a paper's paragraphs names no column of these, so equal places with another style or box would fall as the plan happens to
#: run.  The statement stays as it is; the queries number their paragraphs by all columns.
PLACES, ALL_PLACES = "table_rows, table_cols) - 1 AS para_idx", "table_rows, table_cols, style_name, is_bogi, style_id, has_section_def) - 1 AS para_idx"


#: Paragraphs of a paper meet once: they are numbered where they lie, and so is what is then grouped by paper.
LOOSE, TOGETHER = "FROM raw_paragraphs", "FROM (SELECT /*+ REPARTITION(doc_id) */ * FROM raw_paragraphs) AS met"


def fixture(spark: SparkSession, sf_dir: str, name: str, together: bool = False) -> DataFrame:
    """A projection as a DataFrame; ``together`` deals paragraphs by paper alone."""
    sql = with_fixtures(f"SELECT * FROM {name}", name).replace(PLACES, ALL_PLACES)
    if together:
        sql = sql.replace(LOOSE, TOGETHER)
    for t in NAMES:
        if f" {t}" in sql.replace("\n", " "):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
