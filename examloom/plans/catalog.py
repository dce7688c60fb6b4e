"""Registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import equation, latex, spacing
from ..functions import text as T
from ..operators import compose, furniture, layout, lookup, ordered, segment, tables
from . import packed, questions
from .fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a function under its name, with a statement over the named projections."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_fixtures(sql, *names) if names else sql
        return f

    return take


# Pieces of DuckDB SQL: the text rules again, in RE2 ------------------------------------------
WS = "".join(rf"\x{{{p[2:6]}}}" + (rf"-\x{{{p[-4:]}}}" if "-" in p else "") for p in T.SPACE.replace(r"\u", " \\u").replace("- ", "-").split())


def shown(x: str = "text") -> str:
    return rf"regexp_replace({x}, '[\x02-\x0d\x10-\x18]', '', 'g')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, '[{WS}]*')"


def u32(x: str) -> str:
    return f"CASE WHEN TRY_CAST(nullif({x}, '') AS DECIMAL(38,0)) <= 4294967295 THEN CAST(TRY_CAST(nullif({x}, '') AS DECIMAL(38,0)) AS BIGINT) END"


def qnum(x: str) -> str:
    return "(" + u32(rf"regexp_extract({x}, '^[{WS}]*([0-9]+)[{WS}]*\.(?:[^0-9]|$)', 1)") + ")"


def set_part(x: str, k: int) -> str:
    return "(" + u32(rf"regexp_extract({x}, '\[[{WS}]*([0-9]+)[{WS}]*[{T.TILDES}][{WS}]*([0-9]+)[{WS}]*\]', {k})") + ")"


def is_set(x: str) -> str:
    return f"({set_part(x, 1)} IS NOT NULL AND {set_part(x, 2)} IS NOT NULL)"


def choice(x: str) -> str:
    return f"regexp_matches({x}, '^[{WS}]*[{T.CHOICES}]')"


def any_of(x: str, marks) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


MEMO = f"""(NOT has_section_def AND NOT {blank(shown())} AND NOT {is_set(shown())} AND (first_color <> 0 OR regexp_full_match(lower(style_name), 'xl[0-9]*') OR {any_of(shown(), T.REVIEW_MARKERS)}))"""
MARKED = f""",
marked AS (SELECT *, {shown()} AS s, {MEMO} AS is_memo FROM paragraphs),
q_kinds AS (SELECT *, CASE WHEN {blank('s')} THEN 'empty' WHEN {qnum('s')} IS NOT NULL AND NOT is_memo THEN 'balmun' WHEN {qnum('s')} IS NULL AND {choice('s')} AND NOT is_memo THEN 'seonji' ELSE 'other' END AS kind FROM marked WHERE section_idx = 0),
q_units AS (SELECT *, sum(CAST(kind = 'balmun' AS INT)) OVER (PARTITION BY doc_id ORDER BY para_idx) AS unit FROM q_kinds),
q_ends AS (SELECT *, coalesce(max(CAST(kind = 'seonji' OR (kind = 'other' AND contains(s, '[4점]')) AS INT)) OVER (PARTITION BY doc_id, unit ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM q_units WHERE unit > 0),
q_last AS (SELECT *, max(CASE WHEN kind <> 'empty' OR (has_visual AND ended = 0) THEN para_idx END) OVER (PARTITION BY doc_id, unit) AS last_idx, max(CASE WHEN kind = 'balmun' THEN {qnum('s')} END) OVER (PARTITION BY doc_id, unit) AS n FROM q_ends),
questions AS (SELECT doc_id, CAST(unit AS BIGINT) AS unit_no, printf('Q%02d', n) AS label, para_idx, CASE WHEN kind IN ('balmun', 'seonji') THEN kind ELSE 'middle' END AS role FROM q_last WHERE para_idx <= last_idx AND NOT is_memo),
s_heads AS (SELECT *, {is_set('s')} AND NOT is_memo AS header FROM marked WHERE section_idx = 0),
s_units AS (SELECT *, sum(CAST(header AS INT)) OVER (PARTITION BY doc_id ORDER BY para_idx) AS unit FROM s_heads),
passage_sets AS (SELECT doc_id, CAST(unit AS BIGINT) AS unit_no, max(CASE WHEN header THEN printf('S%02d-%02d', {set_part('s', 1)}, {set_part('s', 2)}) END) OVER (PARTITION BY doc_id, unit) AS label, para_idx,
  CASE WHEN header THEN 'set_header' WHEN {is_set('s')} THEN 'jimun' WHEN {qnum('s')} IS NOT NULL THEN 'balmun' WHEN {choice('s')} THEN 'seonji' ELSE 'jimun' END AS role FROM s_units WHERE unit > 0 AND NOT is_memo)"""
RELABEL = "SELECT doc_id, unit_no, CASE WHEN turn > 1 THEN label || '_' || CAST(turn AS STRING) ELSE label END AS label, para_idx, role FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, label ORDER BY unit_no) AS turn FROM {0})"
SUBJECT = f"""CASE WHEN {any_of('t', T.KOREAN_MARKERS)} OR {any_of('c', T.KOREAN_COMPACT)} THEN 'korean' WHEN {any_of('c', ('과학탐구', '통합과학'))} THEN 'science' WHEN contains(c, '수학영역') OR (contains(c, '5지선다형') AND contains(c, '단답형')) THEN 'math' WHEN contains(c, '사회탐구') OR ({' + '.join(f"CAST(contains(c, '{m}') AS INT)" for m in T.SOCIAL_MARKERS)}) >= 2 THEN 'social' END"""
TEXTS = f", texts AS (SELECT doc_id, string_agg({shown()}, '' ORDER BY section_idx, para_idx) AS t FROM paragraphs GROUP BY doc_id)"
# ----------------------------------------------------------------------------------------------


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_memo(fixture(spark, sf_dir, "paragraphs"))


@query(MARKED + "SELECT * FROM questions", "paragraphs")
def detect_questions(spark, sf_dir):
    return segment.detect_questions(paragraphs(spark, sf_dir))


@query(MARKED + "SELECT * FROM passage_sets", "paragraphs")
def detect_korean_sets(spark, sf_dir):
    return segment.detect_korean_sets(paragraphs(spark, sf_dir))


@query(MARKED + ", both_units AS (SELECT * FROM passage_sets UNION ALL SELECT * FROM questions WHERE doc_id NOT IN (SELECT doc_id FROM passage_sets)) " + RELABEL.format("both_units"), "paragraphs")
def detect_units_auto(spark, sf_dir):
    return segment.detect_units_auto(paragraphs(spark, sf_dir))


@query(MARKED + TEXTS + f", subj AS (SELECT doc_id, {SUBJECT} AS subject FROM (SELECT doc_id, t, regexp_replace(t, '[{WS}]', '', 'g') AS c FROM texts)), both_units AS (SELECT passage_sets.* FROM passage_sets JOIN subj USING (doc_id) WHERE subject = 'korean' UNION ALL SELECT questions.* FROM questions JOIN subj USING (doc_id) WHERE subject <> 'korean') " + RELABEL.format("both_units"), "paragraphs")
def detect_units(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    return segment.detect_units(p, segment.subjects(p))


@query(MARKED + RELABEL.format("questions"), "paragraphs")
def label_dedup(spark, sf_dir):
    return segment.disambiguate(segment.detect_questions(paragraphs(spark, sf_dir)))


@query(TEXTS + f"SELECT doc_id, {SUBJECT} AS subject FROM (SELECT doc_id, t, regexp_replace(t, '[{WS}]', '', 'g') AS c FROM texts)", "paragraphs")
def subject_ladder(spark, sf_dir):
    return segment.subjects(fixture(spark, sf_dir, "paragraphs"))


@query(TEXTS + "SELECT doc_id, t AS text FROM texts", "paragraphs")
def document_text(spark, sf_dir):
    return segment.document_text(fixture(spark, sf_dir, "paragraphs"))


@query(f"SELECT doc_id, section_idx, node_id, text, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY para_idx) - 1 AS para_idx FROM paragraphs WHERE NOT {MEMO}", "paragraphs")
def memo_filter(spark, sf_dir):
    return segment.strip_memos(fixture(spark, sf_dir, "paragraphs")).select("doc_id", "section_idx", "node_id", "text", "para_idx")


@query(f"""SELECT doc_id, section_idx, para_idx, CASE WHEN {is_set('s')} THEN 'set:' || {set_part('s', 1)} || '-' || {set_part('s', 2)} WHEN {qnum('s')} IS NOT NULL THEN 'question:' || {qnum('s')} END AS marker,
  length(nullif(regexp_extract(text, '^[{WS}]*[0-9]+[{WS}]*\\.[{WS}]*', 0), '')) AS prefix, regexp_matches(s, '[A-Za-z가-힣]') AS letters, regexp_replace(s, '[{WS}]', '', 'g') AS compact, {any_of('s', T.REVIEW_MARKERS)} AS review, contains(text, chr(10)) AS broken
FROM (SELECT *, {shown()} AS s FROM paragraphs)""", "paragraphs")
def paragraph_markers(spark, sf_dir):
    s = T.strip_control(F.col("text"))
    return fixture(spark, sf_dir, "paragraphs").select(
        "doc_id", "section_idx", "para_idx", T.line_marker(s).alias("marker"), T.number_prefix_length(F.col("text")).alias("prefix"), T.contains_hangul_or_latin(s).alias("letters"), T.compact(s).alias("compact"), T.is_review_request(s).alias("review"), F.col("text").contains("\n").alias("broken")
    )


ATOM_UNITS = "doc_id, floor(para_idx / 12) AS unit_no"
STATELESS = f"""CASE WHEN {blank('s')} AND NOT has_table AND n_pictures = 0 AND n_equations = 0 THEN 'empty' WHEN has_table AND is_bogi THEN 'bogi_box'
 WHEN has_table AND kor AND {is_set('s')} THEN 'set_header' WHEN has_table THEN '?table' WHEN n_pictures > 0 AND {blank('s')} THEN 'pic_block'
 WHEN kor THEN CASE WHEN {is_set('s')} THEN 'set_header' WHEN contains(s, '(중략)') THEN 'jungryak' WHEN regexp_matches(s, '^[{WS}]*\\*') THEN 'footnote' WHEN {qnum('s')} IS NOT NULL OR (para_shape_id = 43 AND style_id = 3) THEN 'balmun' WHEN {choice('s')} THEN 'seonji' WHEN regexp_matches(s, '^[{WS}]*[“"]') THEN 'jimun_dialog' WHEN para_shape_id = 47 THEN 'jimun_bracket' ELSE 'jimun' END
 WHEN {qnum('s')} IS NOT NULL THEN 'balmun' WHEN {choice('s')} THEN CASE WHEN contains(text, chr(10)) THEN 'seonji_2_row' ELSE 'seonji' END WHEN n_equations > 0 AND NOT regexp_matches(s, '[A-Za-z가-힣]') THEN 'eq_block'
 WHEN subject = 'math' AND para_shape_id = 6 AND style_id = 2 AND n_equations > 0 THEN 'eq_block' ELSE '?text' END"""


@query(f""", seq AS (SELECT doc_id, para_idx, CAST(floor(para_idx / 12) AS BIGINT) AS unit_no, para_idx % 12 AS k, {shown()} AS s, text, n_tables > 0 AS has_table, is_bogi, table_rows, table_cols, n_pictures, n_equations, para_shape_id, style_id,
  CASE doc_id % 3 WHEN 0 THEN 'korean' WHEN 1 THEN 'math' ELSE 'science' END AS subject, doc_id % 3 = 0 AS kor FROM paragraphs WHERE section_idx = 0),
pre AS (SELECT *, {STATELESS} AS a FROM seq),
steps AS (SELECT doc_id, unit_no, k, para_idx, CASE a WHEN '?table' THEN 'data_box' WHEN '?text' THEN 'unknown' ELSE a END AS atom,
    CASE WHEN a IN ('empty', '?text') THEN NULL WHEN a = '?table' THEN 'data_box' ELSE a END AS prev FROM pre WHERE k = 0
  UNION ALL SELECT p.doc_id, p.unit_no, p.k, p.para_idx, r.atom, CASE WHEN r.atom IN ('empty', 'unknown') THEN r.before ELSE r.atom END
  FROM (SELECT pre.*, steps.prev FROM steps JOIN pre ON pre.doc_id = steps.doc_id AND pre.unit_no = steps.unit_no AND pre.k = steps.k + 1) p,
  LATERAL (SELECT p.prev AS before, CASE p.a WHEN '?table' THEN CASE WHEN p.kor AND p.prev IN {segment.PASSAGE} THEN CASE WHEN p.table_rows = 1 AND p.table_cols = 1 THEN 'jimun_data_box' ELSE 'jimun_inline_table' END ELSE 'data_box' END
    WHEN '?text' THEN CASE WHEN p.prev IN {segment.STEM} THEN 'balmun_cont' ELSE 'unknown' END ELSE p.a END AS atom) r)
SELECT doc_id, unit_no, para_idx, atom FROM steps""".replace(", seq AS", ", seq AS", 1), "paragraphs")
def atom_classes(spark, sf_dir):
    p = fixture(spark, sf_dir, "paragraphs").filter("section_idx = 0").withColumn("unit_no", F.floor(F.col("para_idx") / 12)).withColumn("has_table", F.col("n_tables") > 0)
    p = p.withColumn("subject", F.expr("case doc_id % 3 when 0 then 'korean' when 1 then 'math' else 'science' end"))
    return segment.classify_atoms(p).select("doc_id", "unit_no", "para_idx", "atom")


@query(f""", seq AS (SELECT doc_id, para_idx, CAST(floor(para_idx / 12) AS BIGINT) AS unit_no, text, para_idx % 3 = 0 AS b, CASE WHEN para_idx % 3 = 0 THEN {qnum('text')} END AS own FROM paragraphs WHERE section_idx = 0),
runs AS (SELECT *, count(own) OVER (PARTITION BY doc_id, unit_no ORDER BY para_idx) AS g FROM seq)
SELECT doc_id, unit_no, para_idx, CASE WHEN b AND own IS NULL AND max(own) OVER w IS NOT NULL THEN CAST(max(own) OVER w + sum(CAST(b AND own IS NULL AS INT)) OVER w AS STRING) || '. ' || text ELSE text END AS new_text
FROM runs WINDOW w AS (PARTITION BY doc_id, unit_no, g ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "paragraphs")
def korean_numbers(spark, sf_dir):
    p = fixture(spark, sf_dir, "paragraphs").filter("section_idx = 0").withColumn("unit_no", F.floor(F.col("para_idx") / 12)).withColumn("is_balmun", F.col("para_idx") % 3 == 0)
    return segment.normalize_numbers(p).select("doc_id", "unit_no", "para_idx", "new_text")


@query("SELECT para_id FROM line_segs GROUP BY para_id HAVING count(*) >= 2 AND max(abs(vertical_pos)) = 0", "line_segs")
def is_corrupt(spark, sf_dir):
    return ordered.corrupt_paragraphs(fixture(spark, sf_dir, "line_segs"))


@query("SELECT para_id FROM line_segs WHERE segment_width > 0 GROUP BY para_id HAVING count(DISTINCT segment_width) > 1", "line_segs")
def square_wrap(spark, sf_dir):
    return ordered.square_wrapped(fixture(spark, sf_dir, "line_segs"))


@query("SELECT para_id, seg, CAST(vertical_pos + sum(lift) OVER (PARTITION BY para_id ORDER BY seg) AS BIGINT) AS vertical_pos FROM (SELECT *, CASE WHEN vertical_pos < lag(vertical_pos) OVER w THEN lag(vertical_pos + text_height + line_spacing) OVER w - vertical_pos ELSE 0 END AS lift FROM line_segs WINDOW w AS (PARTITION BY para_id ORDER BY seg))", "line_segs")
def restack(spark, sf_dir):
    return ordered.restack(fixture(spark, sf_dir, "line_segs"))


@query("SELECT doc_id, para_id, seg, vertical_pos - first_value(vertical_pos) OVER (PARTITION BY doc_id ORDER BY para_id, seg) AS vertical_pos FROM line_segs", "line_segs")
def rebase(spark, sf_dir):
    return ordered.rebase(fixture(spark, sf_dir, "line_segs"))


@query("SELECT para_id, count(*) AS lines, CAST(sum(text_height + line_spacing) AS BIGINT) AS height, min(vertical_pos) AS top FROM line_segs GROUP BY para_id", "line_segs")
def measure_paragraphs(spark, sf_dir):
    return layout.measure(fixture(spark, sf_dir, "line_segs"))


LINES = ", lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_id, seg) - 1 AS line, vertical_pos, column_start, text_height + line_spacing AS advance FROM line_segs)"


@query(LINES + """, fresh AS (SELECT *, CASE WHEN vertical_pos < lag(vertical_pos) OVER w OR (vertical_pos = lag(vertical_pos) OVER w AND column_start <= lag(column_start) OVER w AND lag(advance) OVER w > 0) THEN 1 ELSE 0 END AS f FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, CAST(floor(c / 2) AS BIGINT) AS page, CAST(c % 2 AS BIGINT) AS "column" FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM fresh)""", "line_segs")
def paginate_heuristic(spark, sf_dir):
    lines = fixture(spark, sf_dir, "line_segs").createOrReplaceTempView("line_segs_v")
    lines = spark.sql(LINES.replace(", lines AS (", "").replace("FROM line_segs)", "FROM line_segs_v"))
    return layout.paginate_heuristic(lines, 2)


BLOCKS = "SELECT para_id % 300 AS doc_id, row_number() OVER (PARTITION BY para_id % 300 ORDER BY para_id) - 1 AS block, sum(text_height + line_spacing) AS height, CASE WHEN para_id % 40 = 0 THEN 'page' WHEN para_id % 33 = 0 THEN 'column' ELSE 'none' END AS break_before FROM line_segs GROUP BY para_id"


@query(f""", blocks AS ({BLOCKS}),
placed AS (SELECT doc_id, block, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS y, CAST(height AS BIGINT) AS filled FROM blocks WHERE block = 0
  UNION ALL SELECT b.doc_id, b.block, n.c, n.y, CAST(n.y + b.height AS BIGINT) FROM placed p JOIN blocks b ON b.doc_id = p.doc_id AND b.block = p.block + 1,
  LATERAL (SELECT CASE WHEN b.break_before = 'page' THEN CAST(floor(p.c / 2) AS BIGINT) * 2 + 2 WHEN b.break_before = 'column' OR (p.filled > 0 AND p.filled + b.height > 60000) THEN p.c + 1 ELSE p.c END AS c,
    CASE WHEN b.break_before <> 'none' OR (p.filled > 0 AND p.filled + b.height > 60000) THEN CAST(0 AS BIGINT) ELSE p.filled END AS y) n)
SELECT doc_id, block, CAST(floor(c / 2) AS BIGINT) AS page, c % 2 AS "column", y FROM placed""", "line_segs")
def paginate_greedy(spark, sf_dir):
    fixture(spark, sf_dir, "line_segs").createOrReplaceTempView("line_segs_v")
    return layout.paginate_greedy(spark.sql(BLOCKS.replace("FROM line_segs", "FROM line_segs_v")), 60000, 2)


@query("""SELECT table_id, CAST(floor(flat / col_count) AS BIGINT) AS grid_row, flat % col_count AS grid_col, max(cell_idx) AS cell_idx FROM (
  SELECT c.table_id, cell_idx, col_count, row_count, (cell_row + dr) * col_count + cell_col + dc AS flat FROM cells c JOIN grids g ON c.table_id = g.table_id, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc) WHERE dr < row_span AND dc < col_span)
WHERE flat < row_count * col_count GROUP BY table_id, flat, col_count""", "cells", "grids")
def table_grid(spark, sf_dir):
    return tables.grid(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


def _extent_sql(span: str, at: str, size: str, count: str, default: int) -> str:
    return f"SELECT g.table_id, p.{at}, CAST(coalesce(nullif(max(c.{size}), 0), {default}) AS BIGINT) AS {size} FROM grids g JOIN (SELECT unnest(range(0, 60)) AS {at}) p ON p.{at} < {count} LEFT JOIN cells c ON c.table_id = g.table_id AND c.{at} = p.{at} AND c.{span} = 1 GROUP BY g.table_id, p.{at}"


@query(_extent_sql("col_span", "cell_col", "width", "col_count", tables.DEFAULT_WIDTH), "cells", "grids")
def column_widths(spark, sf_dir):
    return tables.column_widths(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


@query(_extent_sql("row_span", "cell_row", "height", "row_count", tables.DEFAULT_HEIGHT), "cells", "grids")
def row_heights(spark, sf_dir):
    return tables.row_heights(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


@query(""", base AS (SELECT g.table_id, p.r, box_height, coalesce(max(greatest(c.height, c.content)), 0) AS own FROM grids g JOIN (SELECT unnest(range(0, 60)) AS r) p ON p.r < row_count LEFT JOIN cells c ON c.table_id = g.table_id AND c.cell_row = p.r AND c.row_span = 1 WHERE box_height > 0 GROUP BY g.table_id, p.r, box_height),
gaps AS (SELECT table_id, max(box_height) - sum(own) AS gap, count(*) FILTER (own = 0) AS autos, count(*) AS n FROM base GROUP BY table_id),
parts AS (SELECT base.*, gap, (autos = 0 OR own = 0) AND gap > 0 AS takes, CASE WHEN autos = 0 THEN n ELSE autos END AS m FROM base JOIN gaps USING (table_id))
SELECT table_id, r AS cell_row, CAST(own + CASE WHEN takes THEN floor(gap / m) + CASE WHEN r = max(CASE WHEN takes THEN r END) OVER (PARTITION BY table_id) THEN gap - floor(gap / m) * m ELSE 0 END ELSE 0 END AS BIGINT) AS height FROM parts""", "cells", "grids")
def row_heights_gap_fill(spark, sf_dir):
    return tables.stored_row_heights(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


@query("SELECT table_id, CAST(greatest(coalesce(sum(width) FILTER (cell_row = 0), 0), max(width)) AS BIGINT) AS width FROM cells GROUP BY table_id", "cells")
def table_widths(spark, sf_dir):
    return tables.table_widths(fixture(spark, sf_dir, "cells"))


@query(f"SELECT table_id, CAST(count(*) FILTER (regexp_matches(text, '[{T.CHOICES}]')) AS BIGINT) AS markers FROM cells JOIN grids USING (table_id) WHERE row_count <= 2 AND col_count >= 5 GROUP BY table_id HAVING markers >= 3 AND bool_or(has_picture)", "cells", "grids")
def choice_image_tables(spark, sf_dir):
    return tables.choice_image_tables(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


@query("SELECT table_id FROM cells JOIN grids USING (table_id) WHERE row_count >= 3 AND col_count >= 3 GROUP BY table_id HAVING contains(replace(string_agg(text, '' ORDER BY cell_idx), ' ', ''), '보기')", "cells", "grids")
def bogi_tables(spark, sf_dir):
    return tables.bogi_tables(fixture(spark, sf_dir, "cells"), fixture(spark, sf_dir, "grids"))


@query("SELECT table_id, cell_idx, weight FROM (SELECT table_id, cell_idx, length(text) + 10 * CAST(has_picture AS BIGINT) AS weight, row_number() OVER (PARTITION BY table_id ORDER BY length(text) + 10 * CAST(has_picture AS BIGINT) DESC, cell_idx DESC) AS n FROM cells) WHERE n = 1", "cells")
def heaviest_cells(spark, sf_dir):
    return tables.heaviest_cells(fixture(spark, sf_dir, "cells"))


@query("""SELECT table_id, cell_row + CAST(cell_row >= 1 AS BIGINT) AS cell_row, cell_col, CAST(row_span + CAST(cell_row < 1 AND cell_row + row_span > 1 AS INT) AS BIGINT) AS row_span, CAST(col_span AS BIGINT) AS col_span, text FROM cells
UNION ALL SELECT DISTINCT c.table_id, 1, c.cell_col, 1, 1, '' FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.table_id = c.table_id AND x.cell_row < 1 AND x.cell_row + x.row_span > 1 AND x.cell_col <= c.cell_col AND x.cell_col + x.col_span > c.cell_col)""", "cells")
def insert_row(spark, sf_dir):
    return tables.insert_row(fixture(spark, sf_dir, "cells"), 1)


@query("SELECT table_id, cell_row - CAST(cell_row > 1 AS BIGINT) AS cell_row, cell_col, CAST(row_span - CAST(cell_row <= 1 AND cell_row + row_span > 1 AS INT) AS BIGINT) AS row_span, CAST(col_span AS BIGINT) AS col_span, text FROM cells WHERE NOT (cell_row = 1 AND row_span = 1)", "cells")
def delete_row(spark, sf_dir):
    return tables.delete_row(fixture(spark, sf_dir, "cells"), 1)


@query("""SELECT table_id, cell_idx, cell_row, cell_col, CAST(row_span AS BIGINT) AS row_span, CAST(col_span AS BIGINT) AS col_span, text FROM cells WHERE NOT (cell_row <= 1 AND cell_col <= 1)
UNION ALL SELECT table_id, min(cell_idx), 0, 0, 2, 2, string_agg(text, '' ORDER BY cell_idx) FROM cells WHERE cell_row <= 1 AND cell_col <= 1 GROUP BY table_id""", "cells")
def merge_cells(spark, sf_dir):
    return tables.merge_cells(fixture(spark, sf_dir, "cells"), 0, 0, 1, 1)


@query(""", pieces AS (SELECT *, sum(CAST(kind = 'new_number' AS INT)) OVER (PARTITION BY doc_id, number_type ORDER BY node_id) AS piece FROM controls WHERE kind IN ('auto_number', 'new_number'))
SELECT doc_id, node_id, number_type, CAST(assigned AS BIGINT) AS assigned FROM (SELECT *, coalesce(max(CASE WHEN kind = 'new_number' THEN new_number - 1 END) OVER w, 0) + sum(CAST(kind = 'auto_number' AS INT)) OVER w AS assigned FROM pieces
WINDOW w AS (PARTITION BY doc_id, number_type, piece ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind = 'auto_number'""", "controls")
def auto_numbers(spark, sf_dir):
    return ordered.auto_numbers(fixture(spark, sf_dir, "controls"))


HEADINGS = "SELECT doc_id, node_id, bin_id % 2 AS numbering_id, z_order % 3 AS level, CASE z_order % 3 WHEN 0 THEN '^1.' WHEN 1 THEN '^1-^2)' ELSE '(^3) ^2' END AS template, CAST(CASE bin_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 9 ELSE 10 END AS INT) AS format FROM controls"


def _format_sql(n: str, code: str) -> str:
    circled, ring = "".join(chr(0x2460 + i) for i in range(20)), "".join(chr(0x326E + i) for i in range(14))
    return f"CASE WHEN {code} = 1 AND {n} BETWEEN 1 AND 20 THEN substr('{circled}', CAST({n} AS INT), 1) WHEN {code} = 8 THEN substr('{T.HANGUL_DIGITS}', CAST(({n} - 1) % 14 AS INT) + 1, 1) WHEN {code} = 9 AND {n} BETWEEN 1 AND 14 THEN substr('{ring}', CAST({n} AS INT), 1) WHEN {code} = 10 THEN substr('{T.JAMO_DIGITS}', CAST(({n} - 1) % 14 AS INT) + 1, 1) ELSE CAST({n} AS STRING) END"


@query(f""", heads AS ({HEADINGS}), counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, numbering_id, level ORDER BY node_id) AS n FROM heads),
seen AS (SELECT *, {', '.join(f"coalesce(max(CASE WHEN level = {k} THEN n END) OVER w, 1) AS l{k}" for k in range(3))} FROM counted WINDOW w AS (PARTITION BY doc_id, numbering_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, node_id, replace(replace(replace(template, '^1', {_format_sql('l0', 'format')}), '^2', {_format_sql('l1', 'format')}), '^3', {_format_sql('l2', 'format')}) AS number FROM seen""", "controls")
def heading_numbers(spark, sf_dir):
    fixture(spark, sf_dir, "controls").createOrReplaceTempView("controls_v")
    return ordered.heading_numbers(spark.sql(HEADINGS.replace("FROM controls", "FROM controls_v")))


@query(""", eqs AS (SELECT doc_id, node_id, CASE WHEN doc_id % 2 = 0 THEN width * 75 ELSE width END AS width FROM controls WHERE kind = 'equation'),
old AS (SELECT doc_id FROM eqs GROUP BY doc_id HAVING count(*) FILTER (width > 0) >= 10 AND count(*) FILTER (width > 0 AND width % 75 = 0) * 2 >= count(*) FILTER (width > 0))
SELECT doc_id, node_id, CASE WHEN doc_id IN (SELECT doc_id FROM old) THEN (width * 89932 + 50000) // 100000 ELSE width END AS width FROM eqs""", "controls")
def eq_width_rescale(spark, sf_dir):
    eqs = fixture(spark, sf_dir, "controls").filter("kind = 'equation'").withColumn("width", F.expr("case when doc_id % 2 = 0 then width * 75 else width end"))
    return ordered.rescale_equation_widths(eqs)


@query("""SELECT p.para_id, p.pos, coalesce((SELECT max_by(style, start) FROM (SELECT para_id, text_start AS start, max(seg) AS style FROM line_segs WHERE seg % 2 = 1 GROUP BY para_id, text_start) r WHERE r.para_id = p.para_id AND start <= p.pos),
  (SELECT min_by(style, start) FROM (SELECT para_id, text_start AS start, max(seg) AS style FROM line_segs WHERE seg % 2 = 1 GROUP BY para_id, text_start) r WHERE r.para_id = p.para_id), 0) AS style
FROM (SELECT DISTINCT para_id, text_start + 5 AS pos FROM line_segs) p""", "line_segs")
def run_style_asof(spark, sf_dir):
    segs = fixture(spark, sf_dir, "line_segs")
    runs = segs.filter("seg % 2 = 1").groupBy("para_id", F.col("text_start").alias("start")).agg(F.max("seg").cast("long").alias("style"))
    return ordered.style_at(runs, segs.select("para_id", (F.col("text_start") + 5).alias("pos")).distinct())


CATALOGS = {"template": "SELECT s_suppkey - 1 AS id, CAST(s_nationkey % 7 AS STRING) AS face, s_nationkey % 3 AS bold FROM supplier", "source": "SELECT p_partkey - 1 AS id, CAST(p_size % 11 AS STRING) AS face, p_partkey % 4 AS bold FROM part"}


def _catalogs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    for t in ("supplier", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return [spark.sql(CATALOGS[k]) for k in ("template", "source")]


MERGED = f"""template AS ({CATALOGS['template']}), source AS ({CATALOGS['source']}), have AS (SELECT face, bold, min(id) AS have FROM template GROUP BY face, bold),
entries AS (SELECT source.*, have FROM source LEFT JOIN have USING (face, bold)), fresh AS (SELECT face, bold, row_number() OVER (ORDER BY min(id)) - 1 AS turn FROM entries WHERE have IS NULL GROUP BY face, bold),
merged AS (SELECT id, coalesce(have, (SELECT max(id) + 1 FROM template) + turn) AS new_id, have IS NULL AS added FROM entries LEFT JOIN fresh USING (face, bold))"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def catalog_merge(spark, sf_dir):
    return lookup.merge_catalog(*_catalogs(spark, sf_dir), ["face", "bold"])


@query(f", {MERGED} SELECT table_id, cell_idx, coalesce(new_id, border_fill_id) AS border_fill_id FROM cells LEFT JOIN merged ON border_fill_id = id", "cells")
def id_remap(spark, sf_dir):
    return lookup.remap(fixture(spark, sf_dir, "cells"), "border_fill_id", lookup.merge_catalog(*_catalogs(spark, sf_dir), ["face", "bold"])).select("table_id", "cell_idx", "border_fill_id")


@query("SELECT 'bin' AS kind, bin_id AS ref, count(*) AS uses FROM controls WHERE kind = 'picture' AND bin_id NOT IN (SELECT bin_id FROM bin_data) GROUP BY bin_id", "controls", "bin_data")
def ref_integrity_anti(spark, sf_dir):
    refs = fixture(spark, sf_dir, "controls").filter("kind = 'picture'").select(F.col("bin_id").alias("ref"))
    return lookup.dangling(refs, fixture(spark, sf_dir, "bin_data").select(F.col("bin_id").alias("id")), "bin")


@query("SELECT 'left' AS side, value FROM (SELECT DISTINCT bin_id AS value FROM controls WHERE kind = 'picture' EXCEPT SELECT bin_id FROM bin_data) UNION ALL SELECT 'right', value FROM (SELECT bin_id AS value FROM bin_data EXCEPT SELECT bin_id FROM controls WHERE kind = 'picture')", "controls", "bin_data")
def bindata_except(spark, sf_dir):
    return lookup.set_difference(fixture(spark, sf_dir, "controls").filter("kind = 'picture'").select("bin_id"), fixture(spark, sf_dir, "bin_data").select("bin_id"))


@query("SELECT doc_id, node_id, controls.bin_id, 'data:' || CASE lower(ext) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(data)) AS uri FROM controls JOIN bin_data ON controls.bin_id = bin_data.bin_id WHERE kind = 'picture'", "controls", "bin_data")
def question_images(spark, sf_dir):
    return lookup.images(fixture(spark, sf_dir, "controls"), fixture(spark, sf_dir, "bin_data"))


@query("SELECT DISTINCT c_nationkey AS doc_id, c_mktsegment AS face FROM customer")
def required_faces(spark, sf_dir):
    return lookup.required_faces(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("face")))


@query("SELECT min(p_type) AS face, p_brand AS file FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_partkey % 3 > 0) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 1) GROUP BY p_brand UNION ALL SELECT face, '(미등록)' FROM (SELECT DISTINCT p_name AS face FROM part WHERE p_partkey % 3 = 0) WHERE face NOT IN (SELECT p_type FROM part WHERE p_partkey % 3 > 0)")
def missing_fonts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    manifest = part.filter("p_partkey % 3 > 0").select(F.col("p_type").alias("face"), F.col("p_brand").alias("file")).distinct()
    required = manifest.select("face").union(part.filter("p_partkey % 3 = 0").select("p_name"))
    return lookup.missing_faces(required, manifest, part.filter("p_partkey % 50 = 1").select(F.col("p_brand").alias("file")).distinct())


@query("SELECT atom, para_shape_id, style_id, n FROM (SELECT *, row_number() OVER (PARTITION BY atom ORDER BY n DESC, para_shape_id, style_id) AS r FROM (SELECT substr(text, 1, 1) AS atom, para_shape_id, style_id, count(*) AS n FROM paragraphs GROUP BY ALL)) WHERE r = 1", "paragraphs")
def slot_mode(spark, sf_dir):
    return lookup.slot_modes(fixture(spark, sf_dir, "paragraphs").select(F.substring("text", 1, 1).alias("atom"), "para_shape_id", "style_id"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT doc_id, kind, count(*) AS n FROM controls GROUP BY ALL) a FULL JOIN (SELECT doc_id, kind, count(*) AS n FROM controls WHERE z_order % 7 > 0 GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.kind = b.kind WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)", "controls")
def roundtrip_diff(spark, sf_dir):
    c = fixture(spark, sf_dir, "controls")
    return lookup.count_difference(c, c.filter("z_order % 7 > 0"))


WRAP_SQL = "CASE text_wrap " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.WRAPS.items()) + " END"


@query(f"""SELECT doc_id, CAST(floor(node_id / 10) AS BIGINT) AS unit_no, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'picture') AS pictures, count(*) FILTER (kind = 'equation') AS equations, count(*) FILTER (kind = 'picture' AND NOT treat_as_char) AS floating_pictures, count(*) FILTER (kind = 'picture' AND treat_as_char) AS inline_pictures,
  coalesce(string_agg(CAST(bin_id AS STRING), ',' ORDER BY node_id) FILTER (kind = 'picture'), '') AS picture_bin_data_ids, coalesce(string_agg(CAST(z_order AS STRING), ',' ORDER BY node_id) FILTER (kind = 'picture'), '') AS picture_z_orders, coalesce(string_agg({WRAP_SQL}, ',' ORDER BY node_id) FILTER (kind = 'picture'), '') AS picture_wrap_modes
FROM controls GROUP BY doc_id, floor(node_id / 10)""", "controls")
def unit_contract(spark, sf_dir):
    return lookup.unit_stats(fixture(spark, sf_dir, "controls").withColumn("unit_no", F.floor(F.col("node_id") / 10)))


ITEMS = "SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS seq, o_orderkey % 2 * 20000 + o_orderkey % 7 * 100 AS x, o_orderkey % 500 * 100 AS y, 18000 AS w, 900 AS h, CAST(o_custkey % 2 + o_orderkey % 5 AS INT) % 3 AS border_id, o_orderkey % 4 > 0 AS connect FROM orders"


@query(f"""WITH items AS ({ITEMS}), fresh AS (SELECT *, CASE WHEN border_id = lag(border_id) OVER w AND connect AND abs(x - lag(x) OVER w) < 1000 THEN 0 ELSE 1 END AS f FROM items WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
boxes AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY seq) AS box FROM fresh)
SELECT doc_id, page, border_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM boxes WHERE border_id > 0 GROUP BY doc_id, page, box, border_id""")
def border_islands(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return ordered.border_boxes(spark.sql(ITEMS))


PAGES = "SELECT c_custkey AS doc_id, n + 1 AS page, 6 AS last_page FROM customer CROSS JOIN (SELECT r_regionkey AS n FROM region UNION ALL SELECT 5) AS pages"
MASTERS = "SELECT o_custkey AS doc_id, o_orderkey AS item, CASE o_orderkey % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'even' WHEN 2 THEN 'both' ELSE 'none' END AS apply, o_orderkey % 3 = 0 AS extension, CASE WHEN o_orderkey % 5 = 3 THEN o_orderkey % 7 END AS target, o_orderkey % 5 = 4 AS is_last FROM orders"
PARITY = "((apply = 'odd' AND page % 2 = 1) OR (apply = 'even' AND page % 2 = 0))"


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


@query(f"""WITH pages AS ({PAGES}), masters AS ({MASTERS}), ranked AS (SELECT pages.*, item, target, CASE WHEN target = page THEN 1 WHEN NOT extension AND {PARITY} THEN 2 WHEN NOT extension AND apply = 'both' THEN 3 WHEN page = last_page AND is_last THEN 4 WHEN target <= page THEN 5 END AS rank FROM pages JOIN masters USING (doc_id))
SELECT doc_id, page, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY rank, CASE WHEN rank = 5 THEN -target ELSE 0 END, CASE WHEN rank = 5 THEN -item ELSE item END) AS r FROM ranked WHERE rank IS NOT NULL) WHERE r = 1""")
def pick_master_asof(spark, sf_dir):
    return ordered.pick_masters(_view(spark, sf_dir, PAGES, "customer", "region"), _view(spark, sf_dir, MASTERS, "orders"))


@query(f"""WITH pages AS ({PAGES}), masters AS ({MASTERS}) SELECT doc_id, page, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY rank, item) AS r FROM (SELECT pages.*, item, CASE WHEN {PARITY} THEN 1 WHEN apply = 'both' THEN 2 END AS rank FROM pages JOIN masters USING (doc_id)) WHERE rank IS NOT NULL) WHERE r = 1""")
def pick_furniture(spark, sf_dir):
    return ordered.pick_furniture(_view(spark, sf_dir, PAGES, "customer", "region"), _view(spark, sf_dir, MASTERS, "orders"))


OPS = "SELECT l_orderkey * 10 + l_linenumber AS op_id, CAST(floor(l_orderkey / 16) AS BIGINT) AS page, l_linenumber % 2 AS \"column\", l_partkey * 37 % 90000 AS y FROM lineitem"
BANDS = "SELECT o_orderkey AS unit_no, CAST(floor(o_orderkey / 16) AS BIGINT) AS page, o_orderkey % 2 AS \"column\", o_orderkey * 13 % 80000 AS y0, o_orderkey * 13 % 80000 + 2500 AS y1 FROM orders"


@query(f"SELECT op_id, min(unit_no) AS unit_no FROM ({OPS}) o JOIN ({BANDS}) b ON o.page = b.page AND o.\"column\" = b.\"column\" AND y BETWEEN y0 - 700 AND y1 + 700 GROUP BY op_id")
def crop_attribution_range(spark, sf_dir):
    return layout.crop_owners(_view(spark, sf_dir, OPS.replace('"', "`"), "lineitem"), _view(spark, sf_dir, BANDS.replace('"', "`"), "orders"))


@query("""WITH s AS (SELECT p_partkey AS section_id, p_partkey % 500 AS bx, 30000 + p_size * 97 AS bw, p_size % 4 AS n0, CASE WHEN p_size % 4 < 1 THEN 1 ELSE p_size % 4 END AS n, p_partkey % 3 * 400 AS gap, p_partkey % 3 = 0 AS same, p_partkey % 3 = 1 AS prop, p_partkey % 5 = 0 AS rtl, [1000 + p_size * 10, 2000, 3000 - p_size] AS ws FROM part),
w AS (SELECT *, greatest(bw - (n - 1) * gap, 0) AS room, i FROM s, LATERAL (SELECT unnest(range(0, n)) AS i)),
v AS (SELECT *, CASE WHEN same THEN room // n WHEN prop THEN room * ws[i + 1] // list_sum(ws[1:n]) ELSE ws[i + 1] END AS wid FROM w),
x AS (SELECT *, bx + coalesce(sum(wid + gap) OVER (PARTITION BY section_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS px FROM v)
SELECT section_id, CAST(CASE WHEN rtl THEN n - 1 - i ELSE i END AS BIGINT) AS "column", CAST(px AS BIGINT) AS x, CAST(CASE WHEN i + 1 = n THEN greatest(bx + bw - px, 0) ELSE wid END AS BIGINT) AS width FROM x""")
def column_areas(spark, sf_dir):
    return layout.column_areas(_view(spark, sf_dir, "SELECT p_partkey AS section_id, p_partkey % 500 AS body_x, 30000 + p_size * 97 AS body_w, p_size % 4 AS n, p_partkey % 3 * 400 AS gap, p_partkey % 3 = 0 AS same_width, p_partkey % 3 = 1 AS proportional, p_partkey % 5 = 0 AS rtl, array(CAST(1000 + p_size * 10 AS BIGINT), CAST(2000 AS BIGINT), CAST(3000 - p_size AS BIGINT)) AS widths FROM part", "part"))


OBJECTS = "SELECT p_partkey AS object_id, CASE p_partkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'page' ELSE 'para' END AS rel, CASE p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS h_align, CASE p_size % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'center' ELSE 'bottom' END AS v_align, 59528 AS paper_w, 84188 AS paper_h, 5669 AS margin, p_size * 111 AS w, p_size * 77 AS h, p_partkey % 97 AS h_off, p_partkey % 89 AS v_off, p_partkey % 1000 AS flow_x, p_partkey % 2000 AS flow_y, 25000 AS flow_w FROM part"


def _align_sql(kind: str, base: str, room: str, size: str, off: str) -> str:
    return f"CASE WHEN {kind} = 'center' THEN {base} + CAST(trunc(({room} - {size}) / 2) AS BIGINT) + {off} WHEN {kind} IN ('right', 'bottom') THEN {base} + {room} - {size} - {off} ELSE {base} + {off} END"


@query(f"""SELECT object_id, CAST(CASE rel WHEN 'paper' THEN {_align_sql('h_align', '0', 'paper_w', 'w', 'h_off')} WHEN 'page' THEN {_align_sql('h_align', 'margin', '(paper_w - 2 * margin)', 'w', 'h_off')} ELSE {_align_sql('h_align', 'flow_x', 'flow_w', 'w', 'h_off')} END AS BIGINT) AS x,
  CAST(CASE rel WHEN 'paper' THEN {_align_sql('v_align', '0', 'paper_h', 'h', 'v_off')} WHEN 'page' THEN {_align_sql('v_align', 'margin', '(paper_h - 2 * margin)', 'h', 'v_off')} ELSE flow_y + v_off END AS BIGINT) AS y FROM ({OBJECTS})""")
def anchor_positions(spark, sf_dir):
    return layout.anchors(_view(spark, sf_dir, OBJECTS, "part"))


def _wide_sql(key: str) -> str:
    value = f"regexp_extract(substr(command, strpos(command, '{key}') + {len(key)}), '(?s)^.*?wstring:[^:]*:(.*)$', 1)"
    cut = f"CASE WHEN contains(v, ' HelpState:') THEN split_part(v, ' HelpState:', 1) WHEN contains(v, ' Direction:') THEN split_part(v, ' Direction:', 1) WHEN contains(v, ' Name:') THEN split_part(v, ' Name:', 1) ELSE v END"
    return f"(SELECT CASE WHEN kind = 'ClickHere' AND contains(command, '{key}') THEN nullif(trim({cut}), '') END FROM (SELECT {value} AS v))"


@query(f"SELECT event_id, coalesce(CASE WHEN kind = 'ClickHere' THEN nullif(data_name, '') END, {_wide_sql('Name:')}, {_wide_sql('Direction:')}) AS name, {_wide_sql('Direction:')} AS guide, {_wide_sql('HelpState:')} AS memo, CASE WHEN kind = 'Memo' THEN TRY_CAST(split_part(command, '/', 3) AS BIGINT) END AS memo_no, properties % 2 = 1 AS editable, lower(kind) AS type FROM fields", "fields")
def field_parse(spark, sf_dir):
    f = fixture(spark, sf_dir, "fields")
    kind, command = F.col("kind"), F.col("command")
    return f.select(
        "event_id", T.field_name(kind, command, F.col("data_name")).alias("name"), T.guide_text(kind, command).alias("guide"), T.memo_text(kind, command).alias("memo"),
        F.when(kind == "Memo", T.memo_number(command)).alias("memo_no"), (F.col("properties").bitwiseAND(F.lit(1)) == 1).alias("editable"), T.lookup(kind, T.FIELD_TYPES).alias("type"),
    )


@query("""SELECT event_id, 'Clickhere:set:' || length(i) || ':' || i AS command FROM (SELECT event_id, 'Direction:wstring:' || length(event_type) || ':' || event_type || ' HelpState:wstring:' || length(CAST(user_id AS STRING)) || ':' || user_id || ' ' || CASE WHEN event_id % 2 = 0 THEN 'Name:wstring:' || length('필드' || event_id) || ':' || '필드' || event_id || ' ' ELSE '' END AS i FROM events)""")
def clickhere_commands(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", T.clickhere_command(F.col("event_type"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("필드"), F.col("event_id").cast("string"))).otherwise("")).alias("command"))


@query("""SELECT page_id, CASE k WHEN 0 THEN 'hwp' WHEN 1 THEN 'hwpx' WHEN 2 THEN 'hwp3' ELSE 'unknown' END AS format, CASE WHEN page_id % 2 = 0 THEN 'hwpx' END AS by_name FROM (SELECT page_id, page_id % 5 AS k FROM pages)""")
def format_sniff(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    head = F.expr("case page_id % 5 when 0 then unhex('D0CF11E0A1B11AE1') when 1 then unhex('504B030414000600') when 2 then cast('HWP Document File V3' as binary) when 3 then unhex('D0CF11E0') else cast(html as binary) end")
    name = F.expr("case when page_id % 2 = 0 then '/a.b/시험.HWPX' else '/a.hwp/시험.txt' end")
    return p.select("page_id", T.file_format(head).alias("format"), T.file_type(name).alias("by_name"))


@query("SELECT p_partkey, printf('BIN%04X.%s', p_partkey, 'png') AS name, replace(replace(replace(replace(replace(p_name || '<&>\"''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, CAST(round(p_size * 7200 / 25.4) AS INT) AS units, (p_partkey * 89932 + 50000) // 100000 AS rescaled, CAST(round((0.5 * 95 / 100 + -5 / 100) * 1150 * (p_size + 50) / 100) AS BIGINT) AS advance FROM part")
def scalar_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = F.col
    return p.select(
        "p_partkey", T.bin_name(c("p_partkey"), F.lit("png")).alias("name"), T.xml_escape(F.concat("p_name", F.lit("<&>\"'"))).alias("escaped"), T.mm_to_units(c("p_size")).alias("units"), T.rescaled_equation_width(c("p_partkey")).alias("rescaled"),
        layout.advance(F.lit(0.5), F.lit(95), F.lit(-5), F.lit(1150), c("p_size") + 50).alias("advance"),
    )


@query("SELECT doc_id, section_idx, para_idx, text, CAST(has_visual AS INT) AS n_shapes, has_section_def FROM paragraphs", "paragraphs")
def hwpx_source(spark, sf_dir):
    p = packed.parsed(spark, sf_dir).select(F.col("path").cast("long").alias("doc_id"), F.inline("paragraphs"))
    return p.select("doc_id", "section_idx", "para_idx", "text", "n_shapes", "has_section_def")


@query(MARKED + TEXTS + f""", subj AS (SELECT doc_id, {SUBJECT} AS subject FROM (SELECT doc_id, t, regexp_replace(t, '[{WS}]', '', 'g') AS c FROM texts)),
both_units AS (SELECT passage_sets.* FROM passage_sets JOIN subj USING (doc_id) WHERE subject = 'korean' UNION ALL SELECT questions.* FROM questions JOIN subj USING (doc_id) WHERE subject <> 'korean'), named AS ({RELABEL.format('both_units')})
SELECT doc_id, unit_no, label, subject, string_agg(s, '' ORDER BY para_idx) AS text FROM named JOIN subj USING (doc_id) JOIN (SELECT doc_id, para_idx, s FROM marked WHERE section_idx = 0) USING (doc_id, para_idx) GROUP BY doc_id, unit_no, label, subject""", "paragraphs")
def question_rows(spark, sf_dir):
    return packed.extracted(spark, sf_dir).select(F.col("path").cast("long").alias("doc_id"), F.inline("questions")).drop("images")


@query()
def question_json(spark, sf_dir):
    return questions.papers_json(packed.extracted(spark, sf_dir))


@query()
def equation_latex(spark, sf_dir):
    return latex.convert(fixture(spark, sf_dir, "controls").filter("kind = 'equation'").select("doc_id", "node_id", "script"), "script")


@query()
def equation_trees(spark, sf_dir):
    return fixture(spark, sf_dir, "controls").filter("kind = 'equation'").select("doc_id", "node_id", equation.tree(F.col("script")).alias("tree"))


@query("""SELECT doc_id, string_agg(CASE WHEN kind = 'equation' THEN chr(2) || script || chr(3) ELSE kind END, '' ORDER BY node_id) AS text FROM controls GROUP BY doc_id""", "controls")
def text_eq_marked(spark, sf_dir):
    c = fixture(spark, sf_dir, "controls")
    piece = F.when(F.col("kind") == "equation", F.concat(F.lit("\u0002"), "script", F.lit("\u0003"))).otherwise(F.col("kind"))
    return c.groupBy("doc_id").agg(segment.ordered_text(F.col("node_id"), piece).alias("text"))


@query("SELECT table_id, cell_idx, coalesce('brand' || b.p_size, 'none') AS style FROM cells LEFT JOIN (SELECT p_partkey, p_size FROM part) b ON border_fill_id = p_partkey", "cells")
def border_styles(spark, sf_dir):
    cells = fixture(spark, sf_dir, "cells")
    borders = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("id"), F.concat(F.lit("brand"), F.col("p_size").cast("string")).alias("style"))
    return lookup.resolve_borders(cells, borders)


@query("SELECT page_id AS doc_id, page_id % 120 AS page, 'paper' || page_id || '_' || CASE WHEN page_id % 2 = 0 THEN 'p' ELSE 'q' END || printf('%02d', page_id % 120) || '.svg' AS name FROM pages")
def preview_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return layout.preview_names(p.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 120).alias("page"), F.concat(F.lit("paper"), F.col("page_id").cast("string")).alias("stem"), F.when(F.col("page_id") % 2 == 0, "page").otherwise("question").alias("kind"), F.lit("svg").alias("ext")))


@query()
def page_svgs(spark, sf_dir):
    p = _view(spark, sf_dir, "SELECT l_orderkey AS doc_id, l_suppkey % 3 AS page, l_linenumber AS seq, CASE l_partkey % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'line' ELSE 'text' END AS kind, l_partkey AS x, l_suppkey AS y, l_linenumber * 100 AS w, 50 AS h, l_returnflag AS text FROM lineitem", "lineitem")
    return layout.page_svg(p)


@query("SELECT doc_id, node_id, memo_id FROM (SELECT event_id % 50 AS doc_id, event_id AS node_id, event_id // 7 % 9 AS number, row_number() OVER (PARTITION BY event_id % 50, event_id // 7 % 9 ORDER BY event_id) AS turn FROM events WHERE event_id % 3 = 1) f LEFT JOIN (SELECT o_custkey % 50 AS doc_id, o_orderkey AS memo_id, o_orderkey % 11 AS number, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 11 ORDER BY o_orderkey) AS turn FROM orders) m USING (doc_id, number, turn)")
def memo_bodies(spark, sf_dir):
    f = _view(spark, sf_dir, "SELECT event_id % 50 AS doc_id, event_id AS node_id, CASE event_id % 3 WHEN 1 THEN 'Memo' ELSE 'ClickHere' END AS kind, 'MEMO/x/' || CAST(CAST(floor(event_id / 7) AS BIGINT) % 9 AS STRING) AS command FROM events", "events")
    return compose.attach_memos(f, _view(spark, sf_dir, "SELECT o_custkey % 50 AS doc_id, o_orderkey AS memo_id, o_orderkey % 11 AS number FROM orders", "orders"))


@query("SELECT doc_id, node_id, kind, 8 * coalesce(sum(CAST(gone AS INT)) OVER (PARTITION BY doc_id, parent_node_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM (SELECT doc_id, node_id, node_id // 6 AS parent_node_id, CASE kind WHEN 'shape' THEN 'header' WHEN 'new_number' THEN 'page_hide' ELSE kind END AS kind, kind IN ('shape', 'new_number') AS gone FROM controls) QUALIFY NOT gone", "controls")
def page_controls(spark, sf_dir):
    c = fixture(spark, sf_dir, "controls").selectExpr("doc_id", "node_id", "cast(floor(node_id / 6) as bigint) as parent_node_id", "case kind when 'shape' then 'header' when 'new_number' then 'page_hide' else kind end as kind")
    return compose.strip_page_controls(c).select("doc_id", "node_id", "kind", "shift")


@query("WITH c AS (SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS id, s_suppkey % 3 = 0 AS d FROM supplier), b AS (SELECT doc_id, CASE WHEN bool_or(id = 0 AND d) THEN 0 ELSE 1 END AS k FROM c GROUP BY doc_id) SELECT doc_id, id AS old_id, id + k AS new_id FROM c JOIN b USING (doc_id) UNION ALL SELECT doc_id, NULL, 0 FROM b WHERE k = 1")
def default_numbering(spark, sf_dir):
    c = _view(spark, sf_dir, "SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS id, s_suppkey % 3 = 0 AS d FROM supplier", "supplier")
    return compose.with_default_entry(c, F.col("d"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS item, CASE WHEN o_orderkey % 9 >= 4 THEN o_orderkey % 9 - 3 END AS target, o_orderkey % 9 = 3 AS is_last FROM orders")
def master_targets(spark, sf_dir):
    return compose.master_targets(_view(spark, sf_dir, "SELECT o_custkey AS doc_id, o_orderkey AS item, o_orderkey % 9 AS ext_flags FROM orders", "orders"))


@query("SELECT doc_id, node_id, treat_as_char OR (z_order % 2 = 0 AND text_wrap NOT IN ('BehindText', 'InFrontOfText')) AS in_flow, treat_as_char OR text_wrap IN ('Square', 'Tight', 'Through') AS embedded FROM controls", "controls")
def object_flags(spark, sf_dir):
    c = fixture(spark, sf_dir, "controls")
    rel = F.when(F.col("z_order") % 2 == 0, "PARA").otherwise("PAPER")
    return c.select("doc_id", "node_id", compose.in_flow(F.col("treat_as_char"), rel, F.col("text_wrap")).alias("in_flow"), tables.is_embedded(F.col("treat_as_char"), F.col("text_wrap")).alias("embedded"))


@query("SELECT p_partkey, p_size * 2 + 3 * 1 AS a, p_size * 5 + 3 * 7 + p_partkey AS tx, 4 * 2 + p_size * 1 AS c, 4 * 5 + p_size * 7 + 9 AS ty FROM part")
def affine_products(spark, sf_dir):
    p = _view(spark, sf_dir, "SELECT p_partkey, array(p_size, 3, p_partkey, 4, p_size, 9) AS a, array(2, 0, 5, 1, 6, 7) AS b FROM part", "part")
    m = compose.multiply(F.col("a"), F.col("b"))
    return p.select("p_partkey", m[0].alias("a"), m[2].alias("tx"), m[3].alias("c"), m[5].alias("ty"))


@query("SELECT para_id AS cell_id, CASE WHEN max(vertical_pos + line_height) = 0 THEN 0 ELSE max(vertical_pos + line_height) + para_id % 300 END AS height FROM line_segs GROUP BY para_id", "line_segs")
def cell_heights(spark, sf_dir):
    return compose.content_heights(fixture(spark, sf_dir, "line_segs").select(F.col("para_id").alias("cell_id"), "vertical_pos", "line_height", (F.col("para_id") % 300).alias("padding")))


@query("SELECT l_orderkey AS para_id, CAST(coalesce(max(CASE WHEN v <= 0 THEN greatest(v + h, 0) END), 0) AS BIGINT) AS leading, CAST(coalesce(max(CASE WHEN v > 0 THEN v + h END), 0) AS BIGINT) AS trailing FROM (SELECT l_orderkey, l_partkey % 100 - 50 AS v, l_suppkey AS h FROM lineitem) GROUP BY l_orderkey")
def object_bands(spark, sf_dir):
    return compose.object_bands(_view(spark, sf_dir, "SELECT l_orderkey AS para_id, l_partkey % 100 - 50 AS v_off, l_suppkey AS height FROM lineitem", "lineitem"))


@query("SELECT user_id AS doc_id, '[' || string_agg('{\"kind\":\"' || event_type || '\",\"section\":' || event_id % 3 || ',\"para\":' || event_id % 7 || ',\"value\":\"v' || event_id || '\"}', ',' ORDER BY event_id) || ']' AS json FROM events GROUP BY user_id")
def edit_events_json(spark, sf_dir):
    e = _view(spark, sf_dir, "SELECT user_id AS doc_id, event_id AS seq, event_type AS kind, event_id % 3 AS section, event_id % 7 AS para, 'v' || CAST(event_id AS STRING) AS value FROM events", "events")
    return compose.events_json(e)


@query()
def pages_json(spark, sf_dir):
    return compose.pages_json(paginate_greedy(spark, sf_dir))


@query(f""", seq AS (SELECT doc_id, CAST(floor(para_idx / 12) AS BIGINT) AS unit_no, para_idx, CASE para_idx % 5 WHEN 0 THEN 'set_header' WHEN 1 THEN 'empty' WHEN 2 THEN 'unknown' WHEN 3 THEN 'jimun' ELSE 'empty' END AS atom, doc_id % 2 = 0 AS k FROM paragraphs WHERE section_idx = 0),
kept AS (SELECT *, lag(atom) OVER (PARTITION BY doc_id, unit_no ORDER BY para_idx) AS p FROM seq)
SELECT doc_id, unit_no, para_idx, atom, row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY para_idx) - 1 AS seq FROM kept WHERE atom NOT IN ('empty', 'unknown') OR (k AND atom = 'empty' AND p = 'set_header')""", "paragraphs")
def composed_members(spark, sf_dir):
    p = fixture(spark, sf_dir, "paragraphs").filter("section_idx = 0").selectExpr("doc_id", "cast(floor(para_idx / 12) as bigint) as unit_no", "para_idx", "case para_idx % 5 when 0 then 'set_header' when 1 then 'empty' when 2 then 'unknown' when 3 then 'jimun' else 'empty' end as atom", "case when doc_id % 2 = 0 then 'korean' else 'math' end as subject")
    return compose.composed(p).select("doc_id", "unit_no", "para_idx", "atom", "seq")


@query(rf"SELECT doc_id, section_idx, para_idx, CASE WHEN {is_set('text')} THEN regexp_extract(text, '(?s)(\[[{WS}]*[0-9]+[{WS}]*[{T.TILDES}][{WS}]*[0-9]+[{WS}]*\].*)$', 1) ELSE text END AS text FROM paragraphs", "paragraphs")
def clean_set_headers(spark, sf_dir):
    return compose.clean_set_headers(fixture(spark, sf_dir, "paragraphs").select("doc_id", "section_idx", "para_idx", "text"))


ALIGNED = """SELECT l_orderkey * 10 + l_linenumber AS line_id, CASE l_partkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' WHEN 3 THEN 'justify' ELSE 'distribute' END AS align,
  CAST(l_quantity * 20 AS DOUBLE) AS width, CAST(l_partkey % 900 AS DOUBLE) AS used, l_suppkey % 4 AS blanks, 1 + l_suppkey % 3 AS cells, l_linenumber % 3 = 0 AS is_last FROM lineitem"""


@query(f"""SELECT line_id, CASE align WHEN 'right' THEN slack WHEN 'center' THEN slack / 2 ELSE CAST(0 AS DOUBLE) END AS room,
  CASE WHEN align = 'justify' AND NOT is_last AND blanks > 0 THEN slack / blanks WHEN align = 'distribute' AND cells > 1 THEN slack / (cells - 1) ELSE CAST(0 AS DOUBLE) END AS gap
FROM (SELECT *, greatest(width - used, CAST(0 AS DOUBLE)) AS slack FROM ({ALIGNED}) AS l) AS s""")
def line_room(spark, sf_dir):
    p = _view(spark, sf_dir, ALIGNED, "lineitem")
    return layout.line_fill(p).select("line_id", F.col("lead").alias("room"), "gap")


ATOM_SIGNS = "".join(spacing.CLASSES.values()) + "ax1/|"
ATOMS = f"""SELECT p_partkey AS atom_id, substr('{ATOM_SIGNS}', CAST(p_partkey % {len(ATOM_SIGNS)} AS INT) + 1, 1) || ' y' AS text,
  'z ' || substr('{ATOM_SIGNS}', CAST(p_size * 7 % {len(ATOM_SIGNS)} AS INT) + 1, 1) AS before, 900 + p_size AS size FROM part"""


def _class_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN strpos('{chars}', {x}) > 0 THEN {k}" for k, chars in spacing.CLASSES.items()) + " ELSE 1 END"


@query(f"""SELECT atom_id, l AS left_class, t AS this_class, CAST(size AS DOUBLE) * (list_extract(list_extract({[list(r) for r in spacing.SPACING]}, l + 1), t + 1) * {spacing.UNIT}) / 100 AS space
FROM (SELECT atom_id, size, {_class_sql("substr(before, 3, 1)")} AS l, {_class_sql("substr(text, 1, 1)")} AS t FROM ({ATOMS}) AS a) AS c""")
def atom_spacing(spark, sf_dir):
    atoms = _view(spark, sf_dir, ATOMS, "part")
    left, this = spacing.edge_classes(F.col("before"))[1], spacing.edge_classes(F.col("text"))[0]
    return atoms.select("atom_id", left.alias("left_class"), this.alias("this_class"), spacing.atom_space(left, this, F.col("size")).alias("space"))


FURNITURE = """SELECT l_orderkey AS doc_id, 0 AS section_idx, 4 * n AS node_id, 4 * n + CASE WHEN n % 2 = 1 AND l_partkey % 4 = 0 THEN 7 ELSE 3 END AS end_node_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'endnote' WHEN 1 THEN 'footer' WHEN 2 THEN 'header' WHEN 3 THEN 'table' ELSE 'shape' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) AS l"""
HELD = f"""SELECT doc_id, node_id + 1 AS node_id, node_id AS parent_node_id, 0 AS para_idx FROM ({FURNITURE}) AS a
UNION ALL SELECT doc_id, node_id + 2, node_id, 1 FROM ({FURNITURE}) AS b"""
NESTED = f"""WITH ctl AS ({FURNITURE}), held AS ({HELD}),
around AS (SELECT c.doc_id, c.node_id, bool_or(x.doc_id IS NOT NULL) AS inside, bool_or(coalesce(x.kind <> 'table', FALSE)) AS walled
  FROM ctl c LEFT JOIN ctl x ON x.doc_id = c.doc_id AND x.node_id < c.node_id AND x.end_node_id >= c.node_id GROUP BY c.doc_id, c.node_id),
placed AS (SELECT * FROM ctl JOIN around USING (doc_id, node_id))"""


def _furniture(spark, sf_dir):
    return _view(spark, sf_dir, FURNITURE, "lineitem"), _view(spark, sf_dir, HELD, "lineitem")


@query(f"""{NESTED} SELECT doc_id, section_idx, held.node_id, kind, first + para_idx AS number
FROM (SELECT *, CASE kind WHEN 'header' THEN 100000 ELSE 200000 END + 1000 * (row_number() OVER (PARTITION BY doc_id, kind ORDER BY node_id) - 1) AS first
  FROM placed WHERE NOT inside AND kind IN ('header', 'footer')) AS f JOIN held USING (doc_id) WHERE held.parent_node_id = f.node_id""")
def header_footers(spark, sf_dir):
    return furniture.header_footers(*_furniture(spark, sf_dir))


@query(f"""{NESTED} SELECT doc_id, section_idx, held.node_id, 399999 + row_number() OVER (PARTITION BY doc_id ORDER BY held.node_id) AS number
FROM placed JOIN held USING (doc_id) WHERE held.parent_node_id = placed.node_id AND kind = 'endnote' AND NOT walled""")
def endnotes(spark, sf_dir):
    return furniture.endnotes(*_furniture(spark, sf_dir))


@query(f"""{NESTED} SELECT doc_id, node_id, parent_node_id FROM held WHERE NOT EXISTS
(SELECT 1 FROM placed f WHERE f.doc_id = held.doc_id AND f.kind = 'footer' AND NOT f.inside AND f.node_id < held.node_id AND f.end_node_id >= held.node_id)""")
def cleared_footers(spark, sf_dir):
    controls, held = _furniture(spark, sf_dir)
    return furniture.without_footers(held, controls).select("doc_id", "node_id", "parent_node_id")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS node_id, l_partkey % 3 = 0 AS has_value, l_partkey % 3 = 0 AS has_unit FROM lineitem")
def section_tab_stops(spark, sf_dir):
    c = _view(spark, sf_dir, """SELECT l_orderkey AS doc_id, l_linenumber AS node_id, CASE WHEN l_partkey % 3 = 0 THEN 'page_hide' ELSE 'section_def' END AS kind,
  CASE WHEN l_partkey % 3 = 0 OR l_suppkey % 2 = 1 THEN map('tabStop', '8', 'tabStopVal', '4000', 'tabStopUnit', 'U') ELSE map('tabStop', '8') END AS properties FROM lineitem""", "lineitem")
    kept = furniture.without_tab_stop(c)
    return kept.select("doc_id", "node_id", F.map_contains_key("properties", "tabStopVal").alias("has_value"), F.map_contains_key("properties", "tabStopUnit").alias("has_unit"))


COLUMN_MARKS = """SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS section_idx, o_orderkey AS node_id, CAST(o_orderkey % 4 AS INT) AS count, o_orderkey % 5 <> 0 AS same_width,
  CAST(o_orderkey % 900 AS INT) AS spacing, o_orderkey % 7 = 0 AS right_to_left FROM orders"""


@query(f"SELECT doc_id, section_idx, greatest(count, 1) AS count, same_width, spacing, right_to_left FROM ({COLUMN_MARKS}) AS c QUALIFY row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY node_id) = 1")
def section_columns(spark, sf_dir):
    return furniture.column_layout(_view(spark, sf_dir, COLUMN_MARKS, "orders"))


SHAPES = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'number' ELSE 'none' END AS head_type FROM orders"
COPIES = f"""shapes AS ({SHAPES}), sizes AS (SELECT doc_id, count(*) AS n FROM shapes GROUP BY doc_id),
copies AS (SELECT doc_id, id, n + row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS copy
  FROM (SELECT p.doc_id, s.id, min(p.section_idx * 4294967296 + p.para_idx) AS first FROM paragraphs p JOIN shapes s ON s.doc_id = p.doc_id AND s.id = p.para_shape_id
    WHERE s.head_type = 'number' AND {qnum('text')} IS NOT NULL GROUP BY p.doc_id, s.id) AS f JOIN sizes USING (doc_id))"""


def _unnumbered(spark, sf_dir):
    p = fixture(spark, sf_dir, "paragraphs").select("doc_id", "section_idx", "para_idx", "text", "para_shape_id")
    return furniture.without_numbering(p, _view(spark, sf_dir, SHAPES, "orders"), "section_idx", "para_idx")


@query(f", {COPIES} SELECT p.doc_id, section_idx, para_idx, CASE WHEN {qnum('text')} IS NOT NULL THEN coalesce(copy, para_shape_id) ELSE para_shape_id END AS para_shape_id FROM paragraphs p LEFT JOIN copies c ON c.doc_id = p.doc_id AND c.id = p.para_shape_id", "paragraphs")
def unnumbered_paragraphs(spark, sf_dir):
    return _unnumbered(spark, sf_dir)[0].select("doc_id", "section_idx", "para_idx", "para_shape_id")


@query(f", {COPIES} SELECT doc_id, id, head_type FROM shapes UNION ALL SELECT doc_id, copy, 'none' FROM copies", "paragraphs")
def unnumbered_shapes(spark, sf_dir):
    return _unnumbered(spark, sf_dir)[1]
