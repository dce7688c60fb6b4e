"""Ordered operators: running numbers, as-of lookups, restacked lines, border islands and furniture picks, all as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def auto_numbers(controls: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, number_type, assigned): a running counter for each kind, set by new-number controls.

    Reads kind (auto_number or new_number), number_type, new_number, in the order of node_id.  The sequence is cut at every
    new-number control; inside a piece the number is where the piece starts plus a row count.

    ``starts`` (doc_id, node_id, number_type, new_number) are the start numbers of sections, at a node before all controls of the
    section; each above 0 sets its counter as a new-number control does.
    """
    numbered = controls.filter("kind in ('auto_number', 'new_number')").select("doc_id", "node_id", "kind", "number_type", "new_number")
    if starts is not None:
        numbered = numbered.unionByName(starts.filter("new_number > 0").select("doc_id", "node_id", F.lit("new_number").alias("kind"), "number_type", "new_number"))
    key = Window.partitionBy("doc_id", "number_type").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("kind") == "new_number"
    df = numbered.withColumn("piece", F.sum(new.cast("int")).over(key)).withColumn("base", F.coalesce(F.last(F.when(new, F.col("new_number") - 1), ignorenulls=True).over(key), F.lit(0)))
    piece = Window.partitionBy("doc_id", "number_type", "piece").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("assigned", F.col("base") + F.sum((~new).cast("int")).over(piece))
    return df.filter(~new).select("doc_id", "node_id", "number_type", F.col("assigned").cast("long").alias("assigned"))


def heading_numbers(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, node_id, number): list numbers by (numbering, level); a template's ``^k`` is the running number of level k.

    Reads numbering_id, level, template, format.  A counter is never reset by a higher level; a level not met yet stands at its start, 1.
    """
    level = Window.partitionBy("doc_id", "numbering_id", "level").orderBy("node_id")
    df = paragraphs.withColumn("n", F.row_number().over(level))
    seen = Window.partitionBy("doc_id", "numbering_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    out = F.col("template")
    for k in range(1, 8):
        value = F.coalesce(F.last(F.when(F.col("level") == k - 1, F.col("n")), ignorenulls=True).over(seen), F.lit(1))
        df = df.withColumn(f"_l{k}", value)
        out = F.replace(out, F.lit(f"^{k}"), T.format_number(F.col(f"_l{k}"), F.col("format")))
    return df.select("doc_id", "node_id", out.alias("number"))


def rescale_equation_widths(equations: DataFrame) -> DataFrame:
    """(doc_id, node_id, width): widths of documents on the old unit grid, converted.

    A document uses the old unit if it has ten or more equation widths above 0 and half of them are multiples of 75.
    """
    stats = equations.groupBy("doc_id").agg(F.count_if(F.col("width") > 0).alias("n"), F.count_if((F.col("width") > 0) & (F.col("width") % 75 == 0)).alias("grid"))
    old = stats.filter("n >= 10 and grid * 2 >= n").select("doc_id", F.lit(True).alias("old"))
    return equations.join(old, "doc_id", "left").select("doc_id", "node_id", F.when(F.col("old"), T.rescaled_equation_width(F.col("width"))).otherwise(F.col("width")).cast("long").alias("width"))


def style_at(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """(para_id, pos, style): the run in force at each position: the last that starts at or before it, else the first.

    An as-of join without a range join: runs and probes are sorted together and the last run seen is carried on.
    """
    both = runs.select("para_id", F.col("start").alias("pos"), F.lit(0).alias("side"), "style").unionByName(probes.select("para_id", "pos", F.lit(1).alias("side"), F.lit(None).cast("long").alias("style")))
    order = Window.partitionBy("para_id").orderBy("pos", "side", "style")
    first = F.first("style", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    got = F.coalesce(F.last("style", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), first, F.lit(0).cast("long"))
    return both.withColumn("got", got).filter("side = 1").select("para_id", "pos", F.col("got").alias("style"))


def restack(line_segs: DataFrame) -> DataFrame:
    """(para_id, seg, vertical_pos): tops that only rise: a drop is lifted to just below the line before it, with all that follow."""
    order = Window.partitionBy("para_id").orderBy("seg")
    before = F.lag("vertical_pos").over(order)
    lift = F.when(F.col("vertical_pos") < before, before + F.lag(F.col("text_height") + F.col("line_spacing")).over(order) - F.col("vertical_pos")).otherwise(0)
    df = line_segs.withColumn("lift", lift)
    return df.select("para_id", "seg", (F.col("vertical_pos") + F.sum("lift").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("vertical_pos"))


def rebase(line_segs: DataFrame) -> DataFrame:
    """(doc_id, para_id, seg, vertical_pos): tops less the first top of the unit."""
    order = Window.partitionBy("doc_id").orderBy("para_id", "seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return line_segs.select("doc_id", "para_id", "seg", (F.col("vertical_pos") - F.first("vertical_pos").over(order)).alias("vertical_pos"))


def corrupt_paragraphs(line_segs: DataFrame) -> DataFrame:
    """(para_id): paragraphs of two or more lines that all lie at 0."""
    return line_segs.groupBy("para_id").agg(F.count("*").alias("n"), F.max(F.abs("vertical_pos")).alias("m")).filter("n >= 2 and m = 0").select("para_id")


def square_wrapped(line_segs: DataFrame) -> DataFrame:
    """(para_id): paragraphs with more than one distinct line width above 0."""
    return line_segs.filter("segment_width > 0").groupBy("para_id").agg(F.countDistinct("segment_width").alias("n")).filter("n > 1").select("para_id")


def border_boxes(items: DataFrame) -> DataFrame:
    """Boxes around bordered paragraphs of a page (doc_id, page, seq, x, y, w, h, border_id, connect): gaps and islands.

    An item joins the box before it if it is its neighbour, has the same border, connects, and starts within 1000 units of the box's
    first item; border 0 is no border.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    same = (F.col("border_id") == F.lag("border_id").over(order)) & F.col("connect") & (F.abs(F.col("x") - F.lag("x").over(order)) < 1000)
    df = items.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("box", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter("border_id > 0").groupBy("doc_id", "page", "box", "border_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.count("*").alias("n")).drop("box")


def parity_fits(apply: Column, page: Column) -> Column:
    return ((apply == "odd") & (page % 2 == 1)) | ((apply == "even") & (page % 2 == 0))


def _first_ranked(pages: DataFrame, furniture: DataFrame, rank: Column, then: list[Column]) -> DataFrame:
    both = pages.join(furniture, "doc_id").withColumn("rank", rank).filter("rank is not null")
    best = Window.partitionBy("doc_id", "page").orderBy("rank", *then)
    return both.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("doc_id", "page", "item", "rank")


def pick_furniture(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """(doc_id, page, item, rank): header or footer of each page: one for its parity before one for both."""
    rank = F.when(parity_fits(F.col("apply"), F.col("page")), 1).when(F.col("apply") == "both", 2)
    return _first_ranked(pages, furniture, rank, [F.col("item")])


def pick_masters(pages: DataFrame, masters: DataFrame) -> DataFrame:
    """(doc_id, page, item, rank): master page: its own, its parity's, both, the last page's, or the nearest earlier one."""
    page, target = F.col("page"), F.col("target")
    rank = (
        F.when(target == page, 1)
        .when(~F.col("extension") & parity_fits(F.col("apply"), page), 2)
        .when(~F.col("extension") & (F.col("apply") == "both"), 3)
        .when((page == F.col("last_page")) & F.col("is_last"), 4)
        .when(target <= page, 5)
    )
    near = F.when(F.col("rank") == 5, -target).otherwise(0)
    later = F.when(F.col("rank") == 5, -F.col("item")).otherwise(F.col("item"))
    return _first_ranked(pages, masters, rank, [near, later])
