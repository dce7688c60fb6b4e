"""Previews of parsed papers: the lines of the body on pages and columns, and crops of questions.

A page shows the stored lines of the body without its memos.  A question is one image: its fragments, one a column it spans, below one
another.  A passage set is an image a page.  Boxes are those of the stored lines, as nothing is rasterized here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import furniture, layout, segment
from ..session import stored
from ..sources.papers import part
from .questions import flagged, units

#: Blank margin around a crop, in units of 1/7200 inch.
MARGIN = 1800


def body_lines(papers: DataFrame) -> DataFrame:
    """(doc_id, section_idx, node_id, place, seg, text): stored lines of body paragraphs, each with its own share of the text."""
    p = part(papers.filter("status = 'ok'"), "paragraphs").filter("container = 'body'")
    starts = F.transform("line_segs", lambda s, i: F.struct(s["text_start"].alias("unit"), F.lit(0).alias("char"), i.alias("i")))
    chars = F.transform("char_offsets", lambda o: F.struct(o.alias("unit"), F.lit(1).alias("char"), F.lit(-1).alias("i")))
    merged = F.transform(F.array_sort(F.concat(starts, chars)), lambda x, at: F.struct(x["char"].alias("char"), x["i"].alias("i"), at.alias("at")))
    # the k-th line in order has as many characters before it as its place has other things than lines
    marks = F.transform(F.filter("_merged", lambda x: x["char"] == 0), lambda x, k: F.struct(x["i"].alias("i"), (x["at"] - k).alias("before")))
    p = p.withColumn("_merged", merged).withColumn("_marks", marks)
    rows = p.select("doc_id", "section_idx", "node_id", "text", "line_segs", "_marks", F.posexplode("_marks").alias("place", "_mark"))
    after = F.coalesce(F.try_element_at("_marks", F.col("place") + 2)["before"], F.length("text"))
    share = F.substring(F.col("text"), F.col("_mark.before") + 1, after - F.col("_mark.before"))
    return rows.select("doc_id", "section_idx", "node_id", "place", F.element_at("line_segs", F.col("_mark.i") + 1).alias("seg"), share.alias("text"))


def placed_lines(papers: DataFrame) -> DataFrame:
    """Lines of the body without memos as painted things: (doc_id, node_id, page, column, seq, kind, x, y, w, h, text).

    Each section starts a page and has the columns of its first column control, one if it has none.
    """
    kept = segment.strip_memos(flagged(papers)).select("doc_id", "node_id")
    lines = body_lines(papers).join(kept, ["doc_id", "node_id"], "left_semi").select("doc_id", "section_idx", "node_id", "place", "text", "seg.*")
    n = furniture.column_layout(part(papers, "columns")).select("doc_id", "section_idx", F.col("count").alias("n"))
    lines = lines.join(n, ["doc_id", "section_idx"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("section_idx", "node_id", "place")
    lines = lines.withColumn("line", F.row_number().over(order) - 1).withColumn("advance", F.col("text_height") + F.col("line_spacing"))
    placed = layout.paginate_heuristic(lines, F.col("n"), "section_idx")
    before = Window.partitionBy("doc_id").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("doc_id", "section_idx").agg((F.max("page") + 1).alias("pages"))
    firsts = sizes.select("doc_id", "section_idx", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("first"))
    placed = placed.join(firsts, ["doc_id", "section_idx"]).select("doc_id", "line", (F.col("first") + F.col("page")).alias("page"), "column")
    return lines.join(placed, ["doc_id", "line"]).select(
        "doc_id", "node_id", "page", "column", F.col("line").alias("seq"), F.lit("text").alias("kind"), F.col("column_start").alias("x"), F.col("vertical_pos").alias("y"), F.col("segment_width").alias("w"),
        F.col("line_height").alias("h"), "text",
    )


def unit_paragraphs(papers: DataFrame) -> DataFrame:
    """(doc_id, node_id, unit_no, label): the unit of each body paragraph that is, or holds, one of its paragraphs; the first unit's if several do."""
    members = units(papers).select("doc_id", "node_id", "unit_no", "label")
    body = part(papers.filter("status = 'ok'"), "paragraphs").filter("container = 'body'").select("doc_id", "node_id", F.col("node_id").alias("_top"))
    both = body.unionByName(members, allowMissingColumns=True)
    here = Window.partitionBy("doc_id").orderBy("node_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hosts = both.withColumn("_host", F.max("_top").over(here)).filter("unit_no is not null and _host is not null")
    first = hosts.groupBy("doc_id", "_host").agg(F.min_by(F.struct("unit_no", "label"), "unit_no").alias("u"))
    return first.select("doc_id", F.col("_host").alias("node_id"), "u.unit_no", "u.label")


def crops(ops: DataFrame) -> DataFrame:
    """Painted things of units (doc_id, unit_no, label, page, column, seq, kind, x, y, w, h, text) moved into their images: the same with ``page`` the image's place.

    Fragments go flush left and one below the other; sets (labels with S) keep a page's columns side by side, an image a page.
    """
    paged = F.col("label").startswith("S")
    ops = ops.withColumn("image", F.when(paged, F.col("page")).otherwise(F.lit(0))).withColumn("strip", F.when(paged, F.lit(0)).otherwise(F.col("column")))
    key = ["doc_id", "unit_no", "image"]
    boxes = layout.bounding_boxes(ops, *key, "page", "strip")
    above = Window.partitionBy(*key).orderBy("page", "strip").rowsBetween(Window.unboundedPreceding, -1)
    boxes = boxes.select(*key, "page", "strip", F.col("x").alias("left"), F.col("y").alias("top"), F.coalesce(F.sum("h").over(above), F.lit(0)).alias("above"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no", "image")) - 1
    images = ops.select(*key).distinct().withColumn("number", number)
    moved = ops.join(boxes, [*key, "page", "strip"]).join(images, key)
    x, y = F.col("x") - F.col("left") + MARGIN, F.col("y") - F.col("top") + F.col("above") + MARGIN
    return moved.select("doc_id", "unit_no", "label", F.col("number").alias("page"), "column", "seq", "kind", x.alias("x"), y.alias("y"), "w", "h", "text")


def page_things(papers: DataFrame) -> DataFrame:
    """Painted things of whole pages."""
    return placed_lines(stored(papers))


def question_things(papers: DataFrame) -> DataFrame:
    """Painted things of question images."""
    papers = stored(papers)
    return crops(placed_lines(papers).join(unit_paragraphs(papers), ["doc_id", "node_id"]))
