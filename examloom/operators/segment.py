"""Segmentation of a paper's paragraph sequence into questions or passage sets.

Input: ``paragraphs`` with doc_id, section_idx, para_idx, text (raw), and what each operator names below.  All order is
explicit (para_idx), every window is bounded by a document, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def up_to():
    """A document's paragraphs up to each one."""
    return Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)


def memo_flag(df: DataFrame) -> Column:
    """Editing memos: coloured or spreadsheet-styled text, or a request to the editors; never set headers or section definitions.

    Reads text, first_color, style_name, has_section_def.
    """
    shown = T.strip_control(F.col("text"))
    spreadsheet = F.lower("style_name").rlike("^xl[0-9]*$")
    reason = (F.coalesce(F.col("first_color"), F.lit(0)) != 0) | F.coalesce(spreadsheet, F.lit(False)) | T.is_review_request(shown)
    return ~F.coalesce(F.col("has_section_def"), F.lit(False)) & ~T.is_blank(shown) & ~T.is_set_header(shown) & reason


def strip_memos(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that are no memos, numbered anew in each section."""
    order = Window.partitionBy("doc_id", "section_idx").orderBy("para_idx")
    kept = paragraphs.filter(~memo_flag(paragraphs))
    return kept.withColumn("para_idx", (F.row_number().over(order) - 1).cast("long"))


def _kinds(paragraphs: DataFrame, korean: bool) -> DataFrame:
    shown = T.strip_control(F.col("text"))
    kind = T.classify(shown, F.lit(korean))
    memo = F.col("is_memo")
    kind = F.when(memo & kind.isin("balmun", "seonji"), "other").otherwise(kind)
    return paragraphs.filter("section_idx = 0").withColumn("shown", shown).withColumn("kind", kind)


def with_memo(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("is_memo", memo_flag(paragraphs))


def detect_questions(paragraphs: DataFrame) -> DataFrame:
    """Rows (doc_id, unit_no, label, para_idx, role) of question units.  Reads is_memo and has_visual besides."""
    df = _kinds(paragraphs, False).withColumn("unit", F.sum(F.when(F.col("kind") == "balmun", 1).otherwise(0)).over(up_to())).filter("unit > 0")
    unit = Window.partitionBy("doc_id", "unit").orderBy("para_idx")
    ends = (F.col("kind") == "seonji") | ((F.col("kind") == "other") & F.col("shown").contains(T.FOUR_POINTS))
    before = F.coalesce(F.max(ends.cast("int")).over(unit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("ended", before)
    counts = (F.col("kind") != "empty") | (F.col("has_visual") & (F.col("ended") == 0))
    whole = Window.partitionBy("doc_id", "unit")
    df = df.withColumn("last", F.max(F.when(counts, F.col("para_idx"))).over(whole)).withColumn("n", F.max(F.when(F.col("kind") == "balmun", T.question_number(F.col("shown")))).over(whole))
    df = df.filter((F.col("para_idx") <= F.col("last")) & ~F.col("is_memo"))
    role = F.when(F.col("kind").isin("balmun", "seonji"), F.col("kind")).otherwise("middle")
    return df.select("doc_id", F.col("unit").alias("unit_no"), F.format_string("Q%02d", "n").alias("label"), "para_idx", role.alias("role"))


def detect_korean_sets(paragraphs: DataFrame) -> DataFrame:
    """Rows (doc_id, unit_no, label, para_idx, role) of passage sets, each from a set header to the next."""
    df = _kinds(paragraphs, True)
    header = T.is_set_header(F.col("shown")) & ~F.col("is_memo")
    df = df.withColumn("header", header).withColumn("unit", F.sum(F.when(F.col("header"), 1).otherwise(0)).over(up_to())).filter("unit > 0 and not is_memo")
    whole = Window.partitionBy("doc_id", "unit")
    label = F.max(F.when(F.col("header"), F.format_string("S%02d-%02d", T.set_from(F.col("shown")), T.set_to(F.col("shown"))))).over(whole)
    role = F.when(F.col("header"), "set_header").when(F.col("kind").isin("balmun", "seonji"), F.col("kind")).otherwise("jimun")
    return df.select("doc_id", F.col("unit").alias("unit_no"), label.alias("label"), "para_idx", role.alias("role"))


def detect_units_auto(paragraphs: DataFrame) -> DataFrame:
    """Passage sets where a document has a set header, else questions: no subject needed."""
    shown = T.strip_control(F.col("text"))
    marked = paragraphs.filter("section_idx = 0").groupBy("doc_id").agg(F.max((T.is_set_header(shown) & ~F.col("is_memo")).cast("int")).alias("sets"))
    sets = detect_korean_sets(paragraphs)
    questions = detect_questions(paragraphs).join(marked.filter("sets = 1"), "doc_id", "left_anti")
    return disambiguate(sets.unionByName(questions))


def detect_units(paragraphs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Units of documents with a known subject (doc_id, subject): sets for korean, questions otherwise."""
    subjects = subjects.filter("subject is not null")
    sets = detect_korean_sets(paragraphs).join(subjects.filter("subject = 'korean'"), "doc_id", "left_semi")
    questions = detect_questions(paragraphs).join(subjects.filter("subject <> 'korean'"), "doc_id", "left_semi")
    return disambiguate(sets.unionByName(questions))


def disambiguate(units: DataFrame) -> DataFrame:
    """Second and later units of a label get ``_2``, ``_3`` and so on."""
    order = Window.partitionBy("doc_id", "label").orderBy("unit_no")
    turn = F.dense_rank().over(order)
    return units.withColumn("label", F.when(turn > 1, F.concat("label", F.lit("_"), turn.cast("string"))).otherwise(F.col("label")))


def subjects(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, subject) from each document's whole text; null where no rule fits."""
    return document_text(paragraphs).select("doc_id", T.subject(F.col("text")).alias("subject"))


def ordered_text(order: Column, text: Column) -> Column:
    """Aggregate: texts joined without separator in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "")


def document_text(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): all paragraph texts without control marks, in section and paragraph order."""
    return paragraphs.groupBy("doc_id").agg(ordered_text(F.struct("section_idx", "para_idx"), T.strip_control(F.col("text"))).alias("text"))


#: Atoms after which body text continues a question stem.
STEM = ("eq_block", "data_box", "bogi_box", "balmun", "balmun_cont", "pic_block")
PASSAGE = ("jimun", "jimun_dialog", "jimun_bracket", "jimun_data_box", "jimun_inline_table")


def classify_atoms(paragraphs: DataFrame) -> DataFrame:
    """One of the paper's atoms for each paragraph of a unit (doc_id, unit_no, para_idx, subject).

    Reads has_table, is_bogi, table_rows, table_cols, n_pictures, n_equations, para_shape_id, style_id.  What depends on the atom before
    (a continued stem, a Korean table inside a passage) is resolved in a second step: the chain of undecided rows takes the
    last decided class, since a continuation keeps the chain alive and unknown rows do not touch it.
    """
    raw = F.col("text")
    shown = T.strip_control(raw)
    korean = F.col("subject") == "korean"
    table, pics, eqs = F.col("has_table"), F.col("n_pictures") > 0, F.col("n_equations") > 0
    blank = T.is_blank(shown)
    left = F.regexp_replace(shown, f"^[{T.SPACE}]+", "")
    stateless = (
        F.when(blank & ~table & ~pics & ~eqs, "empty")
        .when(table & F.col("is_bogi"), "bogi_box")
        .when(table & korean & T.is_set_header(shown), "set_header")
        .when(table & korean, "?table")
        .when(table, "data_box")
        .when(pics & blank, "pic_block")
        .when(korean & T.is_set_header(shown), "set_header")
        .when(korean & shown.contains("(중략)"), "jungryak")
        .when(korean & left.startswith("*"), "footnote")
        .when(korean & (T.question_number(shown).isNotNull() | ((F.col("para_shape_id") == 43) & (F.col("style_id") == 3))), "balmun")
        .when(korean & T.is_choice(shown), "seonji")
        .when(korean & left.rlike('^[“"]'), "jimun_dialog")
        .when(korean & (F.col("para_shape_id") == 47), "jimun_bracket")
        .when(korean, "jimun")
        .when(T.question_number(shown).isNotNull(), "balmun")
        .when(T.is_choice(shown), F.when(raw.contains("\n"), "seonji_2_row").otherwise("seonji"))
        .when(eqs & ~T.contains_hangul_or_latin(shown), "eq_block")
        .when((F.col("subject") == "math") & (F.col("para_shape_id") == 6) & (F.col("style_id") == 2) & eqs, "eq_block")
        .otherwise("?text")
    )
    df = paragraphs.withColumn("_atom", stateless)
    unit = Window.partitionBy("doc_id", "unit_no").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    decided = F.last(F.when(~F.col("_atom").isin("empty", "?text", "?table"), F.col("_atom")), ignorenulls=True).over(unit)
    decided_or_table = F.last(F.when(~F.col("_atom").isin("empty", "?text"), F.col("_atom")), ignorenulls=True).over(unit)
    inside = F.when(decided.isin(*PASSAGE), F.when((F.col("table_rows") == 1) & (F.col("table_cols") == 1), "jimun_data_box").otherwise("jimun_inline_table")).otherwise("data_box")
    # a Korean table right after a data box is a data box too, and then the chain holds data_box
    after_table = F.when(decided_or_table == "?table", decided).otherwise(decided_or_table)
    atom = F.when(F.col("_atom") == "?table", inside).when(F.col("_atom") == "?text", F.when(after_table.isin(*STEM), "balmun_cont").otherwise("unknown")).otherwise(F.col("_atom"))
    return df.withColumn("atom", atom).drop("_atom")


def normalize_numbers(paragraphs: DataFrame) -> DataFrame:
    """Korean question numbers carried forward: where a balmun has none, the last number plus one is prefixed.

    Reads (doc_id, unit_no, para_idx, text, is_balmun); adds new_text.
    """
    unit = Window.partitionBy("doc_id", "unit_no").orderBy("para_idx")
    own = F.when(F.col("is_balmun"), T.question_number(F.col("text")))
    df = paragraphs.withColumn("_own", own)
    df = df.withColumn("_seen", F.last("_own", ignorenulls=True).over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_group", F.count("_own").over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "unit_no", "_group").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.col("is_balmun") & F.col("_own").isNull()
    ahead = F.sum(bare.cast("int")).over(run)
    text = F.when(bare & F.col("_seen").isNotNull(), F.concat((F.col("_seen") + ahead).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    return df.withColumn("new_text", text).drop("_own", "_seen", "_group")
