"""What surrounds the body of a paper: headers, footers, endnotes, columns, and what composition takes out of them.

Nodes are numbered in pre-order, so what is nested in a control lies between its node and its last one.  Nesting is told by a
running maximum over a document's nodes, never by pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Where the numbers of headers' and footers' paragraphs begin, the room of each, and where those of endnotes begin.
HEADERS, FOOTERS, ROOM, ENDNOTES = 100_000, 200_000, 1000, 400_000
TAB_STOPS = ("tabStopVal", "tabStopUnit")


def with_inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node_id, ...) with ``inside``: whether a span (doc_id, node_id, end_node_id) that begins before the node holds it."""
    marks = spans.select("doc_id", "node_id", F.col("end_node_id").alias("_end"))
    both = rows.withColumn("_span", F.lit(0)).unionByName(marks.withColumn("_span", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("node_id", "_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("_end").over(before)
    return both.withColumn("inside", F.coalesce(last >= F.col("node_id"), F.lit(False))).filter("_span = 0").drop("_span", "_end")


def header_footers(controls: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, section_idx, node_id, kind, number): paragraphs of the headers and footers that hang on the body, with numbers of their own."""
    own = with_inside(controls.select("doc_id", "section_idx", "node_id", "kind"), controls).filter("not inside and kind in ('header', 'footer')")
    turn = F.row_number().over(Window.partitionBy("doc_id", "section_idx", "kind").orderBy("node_id")) - 1
    first = F.when(F.col("kind") == "header", HEADERS).otherwise(FOOTERS) + ROOM * turn
    of = own.select("doc_id", "section_idx", F.col("node_id").alias("parent_node_id"), "kind", first.alias("_first"))
    got = paragraphs.select("doc_id", "parent_node_id", "node_id", "para_idx").join(of, ["doc_id", "parent_node_id"])
    return got.select("doc_id", "section_idx", "node_id", "kind", (F.col("_first") + F.col("para_idx")).cast("long").alias("number"))


def endnotes(controls: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, section_idx, node_id, number): endnote paragraphs in order; a note may sit in the body or in cells, however deep, but in no other control."""
    own = with_inside(controls.select("doc_id", "section_idx", "node_id", "kind"), controls.filter("kind <> 'table'")).filter("not inside and kind = 'endnote'")
    got = paragraphs.select("doc_id", "parent_node_id", "node_id").join(own.select("doc_id", "section_idx", F.col("node_id").alias("parent_node_id")), ["doc_id", "parent_node_id"])
    turn = F.row_number().over(Window.partitionBy("doc_id", "section_idx").orderBy("node_id")) - 1
    return got.select("doc_id", "section_idx", "node_id", (ENDNOTES + turn).cast("long").alias("number"))


def without_footers(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """``rows`` (paragraphs, controls or cells) but what is nested in the body's footers; the footers themselves stay."""
    footers = with_inside(controls.select("doc_id", "node_id", "end_node_id", "kind"), controls).filter("not inside and kind = 'footer'")
    return with_inside(rows, footers).filter("not inside").drop("inside")


def without_tab_stop(controls: DataFrame) -> DataFrame:
    """Controls whose sections no longer set a default tab stop."""
    kept = F.map_filter("properties", lambda k, _: ~k.isin(*TAB_STOPS))
    return controls.withColumn("properties", F.when(F.col("kind") == "section_def", kept).otherwise(F.col("properties")))


def column_layout(columns: DataFrame) -> DataFrame:
    """The first column control of each section: (doc_id, section_idx, count, same_width, spacing, right_to_left); a count is at least one."""
    names = ("count", "same_width", "spacing", "right_to_left")
    first = columns.groupBy("doc_id", "section_idx").agg(F.min_by(F.struct(*names), "node_id").alias("f"))
    return first.select("doc_id", "section_idx", F.greatest("f.count", F.lit(1)).alias("count"), *(F.col(f"f.{n}").alias(n) for n in names[1:]))


def without_numbering(paragraphs: DataFrame, shapes: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs that bring a question number get a copy of their numbered shape that numbers nothing.

    Returns the paragraphs (doc_id, ``order``, text, para_shape_id, ...) and the shapes (doc_id, id, head_type, ...); copies go behind the
    document's shapes in the order they are first used.
    """
    numbered = shapes.filter("head_type = 'number'").select("doc_id", F.col("id").alias("para_shape_id"))
    own = paragraphs.filter(T.question_number(F.col("text")).isNotNull())
    used = own.join(numbered, ["doc_id", "para_shape_id"]).groupBy("doc_id", "para_shape_id").agg(F.min(F.struct(*order)).alias("_first"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")) - 1
    count = shapes.groupBy("doc_id").agg(F.count("*").alias("_n"))
    copies = used.withColumn("_turn", turn).join(count, "doc_id").select("doc_id", "para_shape_id", (F.col("_n") + F.col("_turn")).cast("int").alias("_copy"))
    wants = T.question_number(F.col("text")).isNotNull()
    moved = paragraphs.join(copies, ["doc_id", "para_shape_id"], "left").withColumn("para_shape_id", F.when(wants, F.coalesce("_copy", "para_shape_id")).otherwise(F.col("para_shape_id")))
    plain = {"head_type": F.lit("none"), "numbering_id": F.lit(0), "para_level": F.lit(0)}
    made = shapes.join(copies, (shapes["id"] == copies["para_shape_id"]) & (shapes["doc_id"] == copies["doc_id"])).drop(copies["doc_id"])
    made = made.withColumns({k: v for k, v in plain.items() if k in shapes.columns}).withColumn("id", F.col("_copy"))
    return moved.select(*paragraphs.columns), shapes.unionByName(made.select(*shapes.columns))
