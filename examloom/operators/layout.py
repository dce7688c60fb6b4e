"""Layout from stored geometry: measures, columns, pagination, anchors, and which question a painted thing belongs to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: How far, in units, a thing may lie outside a question's band and still belong to it.
CROP_SLACK = 700


def reading_order() -> WindowSpec:
    """A document's lines as they are read: section, paragraph, place in it."""
    return Window.partitionBy("doc_id").orderBy("section_idx", "node_id", "text_start", "vertical_pos")


def measure(line_segs: DataFrame) -> DataFrame:
    """(para_id, lines, height, top): a line advances by its text height and the spacing after it."""
    return line_segs.groupBy("para_id").agg(F.count("*").alias("lines"), F.sum(F.col("text_height") + F.col("line_spacing")).alias("height"), F.min("vertical_pos").alias("top"))


def column_areas(sections: DataFrame) -> DataFrame:
    """(section_id, column, x, width): columns of a body (body_x, body_w) by layout (n, gap, same_width, proportional, widths, rtl).

    Equal columns share what the gaps leave; proportional ones by weight; others have their widths.  The last column takes
    what is left.  Right-to-left layouts count from the other end.
    """
    n = F.greatest("n", F.lit(1))
    gap = F.greatest("gap", F.lit(0))
    room = F.greatest(F.col("body_w") - (n - 1) * gap, F.lit(0))
    equal = F.col("same_width") | (F.size("widths") < n)
    total = F.greatest(F.aggregate(F.slice("widths", F.lit(1), n), F.lit(0).cast("long"), lambda a, w: a + F.greatest(w, F.lit(0).cast("long"))), F.lit(1))
    df = sections.withColumn("n", n).withColumn("gap", gap).withColumn("room", room).withColumn("equal", equal).withColumn("total", total)
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    own = F.greatest(F.try_element_at("widths", F.col("i") + 1), F.lit(0).cast("long"))
    width = F.when(F.col("equal"), F.floor(F.col("room") / F.col("n"))).when(F.col("proportional"), F.floor(F.col("room") * own / F.col("total"))).otherwise(own)
    before = Window.partitionBy("section_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("w", width).withColumn("x", F.col("body_x") + F.coalesce(F.sum(F.col("w") + F.col("gap")).over(before), F.lit(0)))
    last = F.col("i") + 1 == F.col("n")
    w = F.when(last, F.greatest(F.col("body_x") + F.col("body_w") - F.col("x"), F.lit(0))).otherwise(F.col("w"))
    column = F.when(F.col("rtl"), F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))
    return df.select("section_id", column.cast("long").alias("column"), F.col("x").cast("long").alias("x"), w.cast("long").alias("width"))


def paginate_heuristic(lines: DataFrame, columns: int | Column, *within: str) -> DataFrame:
    """(doc_id, …, line, page, column): breaks recovered from stored tops, as windows.

    A line starts a new column where its top falls below the one before, or stays while that one has height and the line does not
    move right.  Pages are counted in a document, or in each part of it that ``within`` names.
    """
    order = Window.partitionBy("doc_id", *within).orderBy("line")
    top, start = F.lag("vertical_pos").over(order), F.lag("column_start").over(order)
    reset = (F.col("vertical_pos") < top) | ((F.col("vertical_pos") == top) & (F.col("column_start") <= start) & (F.lag("advance").over(order) > 0))
    df = lines.withColumn("_new", F.when(F.coalesce(reset, F.lit(False)), 1).otherwise(0)).withColumn("_col", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select("doc_id", *within, "line", F.floor(F.col("_col") / columns).alias("page"), (F.col("_col") % columns).alias("column"))


def paginate_greedy(blocks: DataFrame, body_height: int, columns: int) -> DataFrame:
    """(doc_id, block, page, column, y): blocks placed top down; one that does not fit starts the next column, breaks are obeyed.

    A column's fill is reset by what was placed before, which no window frame can tell, so a document is folded in order; each is one
    group of bounded size.  Reads height and break_before (none, page or column).
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        col, y, out = 0, 0, []
        for i, (block, height, before) in enumerate(pdf.sort_values("block")[["block", "height", "break_before"]].itertuples(index=False)):
            if i and before == "page":
                col, y = (col // columns + 1) * columns, 0
            elif i and before == "column":
                col, y = col + 1, 0
            elif y > 0 and y + height > body_height:
                col, y = col + 1, 0
            out.append((pdf["doc_id"].iloc[0], block, col // columns, col % columns, y))
            y += height
        return pd.DataFrame(out, columns=["doc_id", "block", "page", "column", "y"])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.select("doc_id", "block", "height", "break_before").groupBy("doc_id").applyInPandas(place, f"doc_id {kind}, block long, page long, column long, y long")


def align(kind: Column, base: Column, room: Column, size: Column, offset: Column) -> Column:
    """Near edge of ``size`` in a span: centred, at the far edge (offset inwards), or at the near edge."""
    half = (room - size) / 2
    return F.when(kind == "center", base + F.when(half >= 0, F.floor(half)).otherwise(F.ceil(half)) + offset).when(kind.isin("right", "bottom"), base + room - size - offset).otherwise(base + offset)


def anchors(objects: DataFrame) -> DataFrame:
    """(object_id, x, y) of floating objects by reference (paper, page, else the flow) and alignment on each axis."""
    rel, o = F.col("rel"), F.col
    x = F.when(rel == "paper", align(o("h_align"), F.lit(0), o("paper_w"), o("w"), o("h_off"))).when(rel == "page", align(o("h_align"), o("margin"), o("paper_w") - 2 * o("margin"), o("w"), o("h_off"))).otherwise(align(o("h_align"), o("flow_x"), o("flow_w"), o("w"), o("h_off")))
    y = F.when(rel == "paper", align(o("v_align"), F.lit(0), o("paper_h"), o("h"), o("v_off"))).when(rel == "page", align(o("v_align"), o("margin"), o("paper_h") - 2 * o("margin"), o("h"), o("v_off"))).otherwise(o("flow_y") + o("v_off"))
    return objects.select("object_id", x.cast("long").alias("x"), y.cast("long").alias("y"))


def crop_owners(ops: DataFrame, bands: DataFrame, step: int = 4096) -> DataFrame:
    """(op_id, unit_no): the unit whose band (page, column, y0, y1) holds each painted thing (page, column, y), with slack; lowest unit first.

    The range join is an equi-join on y cut into steps: a band is listed under every step it touches.
    """
    low, high = F.col("y0") - CROP_SLACK, F.col("y1") + CROP_SLACK
    listed = bands.select("*", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))).alias("cell"))
    both = ops.withColumn("cell", F.floor(F.col("y") / step)).join(listed, ["page", "column", "cell"]).filter((F.col("y") >= low) & (F.col("y") <= high))
    return both.groupBy("op_id").agg(F.min("unit_no").alias("unit_no"))


def advance(em: Column, ratio: Column, spacing: Column, size: Column, rel: Column) -> Column:
    """Advance of a glyph in units."""
    return F.round((em * ratio / 100 + spacing / 100) * size * rel / 100).cast("long")


def preview_names(pages: DataFrame) -> DataFrame:
    """(doc_id, page, name): file names of previews, ``stem_pNN.ext`` for pages and ``stem_qNN.ext`` for questions."""
    return pages.select("doc_id", "page", F.format_string("%s_%s%02d.%s", "stem", F.when(F.col("kind") == "page", "p").otherwise("q"), F.col("page"), F.col("ext")).alias("name"))


def page_svg(ops: DataFrame) -> DataFrame:
    """(doc_id, page, svg): the painted things of a page (rectangles, lines, texts), back to front, as SVG; units become 1/96 inch."""

    def px(c: str) -> Column:
        return F.format_string("%.2f", F.col(c) * 96.0 / 7200)

    rect = F.format_string('<rect x="%s" y="%s" width="%s" height="%s"/>', px("x"), px("y"), px("w"), px("h"))
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s"/>', px("x"), px("y"), F.format_string("%.2f", (F.col("x") + F.col("w")) * 96.0 / 7200), F.format_string("%.2f", (F.col("y") + F.col("h")) * 96.0 / 7200))
    text = F.format_string('<text x="%s" y="%s">%s</text>', px("x"), px("y"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    body = F.when(F.col("kind") == "rect", rect).when(F.col("kind") == "line", line).otherwise(text)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", body.alias("s")))), lambda p: p["s"]), "")
    return ops.groupBy("doc_id", "page").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), parts, F.lit("</svg>")).alias("svg"))


def line_fill(lines: DataFrame) -> DataFrame:
    """(line_id, lead, gap): where a line starts and what each blank gains, by alignment (left, right, center, justify, distribute).

    Reads width (of the segment), used (sum of advances), blanks, cells and is_last; a justified last line stays left.
    """
    slack = F.greatest(F.col("width") - F.col("used"), F.lit(0.0))
    lead = F.when(F.col("align") == "right", slack).when(F.col("align") == "center", slack / 2).otherwise(0.0)
    justify = (F.col("align") == "justify") & ~F.col("is_last") & (F.col("blanks") > 0)
    spread = (F.col("align") == "distribute") & (F.col("cells") > 1)
    return lines.select("line_id", lead.alias("lead"), F.when(justify, slack / F.col("blanks")).when(spread, slack / (F.col("cells") - 1)).otherwise(0.0).alias("gap"))


def bounding_boxes(ops: DataFrame, *key: str) -> DataFrame:
    """Box around the painted things (x, y, w, h) of each key."""
    return ops.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


def column_of(things: DataFrame, columns: DataFrame) -> DataFrame:
    """(op_id, column): the column (section_id, column, x, width) that holds a thing's x, else the one with the nearest centre."""
    both = things.select("op_id", "section_id", F.col("x").alias("at")).join(columns, "section_id")
    inside = (F.col("at") >= F.col("x")) & (F.col("at") < F.col("x") + F.col("width"))
    order = F.struct((~inside).alias("out"), F.when(inside, F.lit(0.0)).otherwise(F.abs(F.col("at") - F.col("x") - F.col("width") / 2)).alias("far"), F.col("column").alias("column"))
    return both.groupBy("op_id").agg(F.min(order)["column"].alias("column"))


def stack(fragments: DataFrame) -> DataFrame:
    """(unit_no, seq, y): fragments of a unit one below the other, with the room of those before."""
    order = Window.partitionBy("unit_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return fragments.select("unit_no", "seq", F.coalesce(F.sum("h").over(order), F.lit(0)).alias("y"))
