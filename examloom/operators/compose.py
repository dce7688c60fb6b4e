"""Composition rules and document-level rewrites: what a question keeps, ids that shift, memos that find their field, JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Controls of the source page that a composed question does not carry.
PAGE_CONTROLS = ("section_def", "column_def", "header", "footer", "page_hide", "page_number")


def composed(members: DataFrame) -> DataFrame:
    """Members of units (doc_id, unit_no, para_idx, atom, subject) that a question keeps, numbered anew.

    Empty and unknown atoms go; in Korean papers the first spacer after the set header stays.
    """
    unit = Window.partitionBy("doc_id", "unit_no").orderBy("para_idx")
    dropped = F.col("atom").isin("empty", "unknown")
    spacer = (F.col("subject") == "korean") & (F.col("atom") == "empty") & (F.lag("atom").over(unit) == "set_header")
    kept = members.withColumn("_keep", ~dropped | F.coalesce(spacer, F.lit(False))).filter("_keep").drop("_keep")
    return kept.withColumn("seq", F.row_number().over(unit) - 1)


def clean_set_headers(paragraphs: DataFrame) -> DataFrame:
    """(…, text): set headers keep what stands from their bracket on."""
    at = F.regexp_extract("text", "(?s)(" + T.SET_HEADER + ".*)$", 1)
    return paragraphs.withColumn("text", F.when(T.is_set_header(F.col("text")), at).otherwise(F.col("text")))


def strip_page_controls(controls: DataFrame) -> DataFrame:
    """Controls without those of the page, and how many units those before each one gave back (8 each)."""
    gone = F.col("kind").isin(*PAGE_CONTROLS)
    order = Window.partitionBy("doc_id", "parent_node_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    moved = controls.withColumn("shift", 8 * F.coalesce(F.sum(gone.cast("int")).over(order), F.lit(0)))
    return moved.filter(~gone)


def attach_memos(fields: DataFrame, memos: DataFrame) -> DataFrame:
    """(doc_id, node_id, memo_id): memo bodies on memo fields by number; of several with one number the n-th takes the n-th."""
    number = T.memo_number(F.col("command"))
    turn = Window.partitionBy("doc_id", "number").orderBy("node_id")
    a = fields.filter("kind = 'Memo'").select("doc_id", "node_id", number.alias("number")).filter("number is not null").withColumn("turn", F.row_number().over(turn))
    b = memos.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("memo_id")))
    return a.join(b.select("doc_id", "number", "turn", "memo_id"), ["doc_id", "number", "turn"], "left").select("doc_id", "node_id", "memo_id")


def with_default_entry(catalog: DataFrame, is_default: Column) -> DataFrame:
    """(doc_id, old_id, new_id): a default entry goes to the front of each catalog whose first entry is not one; others move on by one.

    The new entry itself has no old_id.
    """
    first = catalog.filter("id = 0").select("doc_id", is_default.alias("has"))
    docs = catalog.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.when(F.coalesce("has", F.lit(False)), 0).otherwise(1).alias("by"))
    moved = catalog.join(docs, "doc_id").select("doc_id", F.col("id").cast("long").alias("old_id"), (F.col("id") + F.col("by")).cast("long").alias("new_id"))
    new = docs.filter("by = 1").select("doc_id", F.lit(None).cast("long").alias("old_id"), F.lit(0).cast("long").alias("new_id"))
    return moved.unionByName(new)


def master_targets(masters: DataFrame) -> DataFrame:
    """(doc_id, item, target, is_last) of master pages by their flags: 3 is the last page, 4 and more the page less 3."""
    flags = F.col("ext_flags")
    return masters.select("doc_id", "item", F.when(flags >= 4, flags - 3).alias("target"), (flags == 3).alias("is_last"))


def in_flow(treat_as_char: Column, vert_rel_to: Column, wrap: Column) -> Column:
    """Whether an object takes room in the text: inline, or hung on its paragraph and neither behind nor before it."""
    return treat_as_char | ((F.lower(vert_rel_to) == "para") & ~wrap.isin("BehindText", "InFrontOfText"))


def multiply(a: Column, b: Column) -> Column:
    """Product of two affine 2x3 matrices given as arrays [a, b, tx, c, d, ty]."""
    x, y = [a[i] for i in range(6)], [b[i] for i in range(6)]
    return F.array(
        x[0] * y[0] + x[1] * y[3], x[0] * y[1] + x[1] * y[4], x[0] * y[2] + x[1] * y[5] + x[2],
        x[3] * y[0] + x[4] * y[3], x[3] * y[1] + x[4] * y[4], x[3] * y[2] + x[4] * y[5] + x[5],
    )


def content_heights(lines: DataFrame) -> DataFrame:
    """(cell_id, height): the lowest line's bottom and the padding; 0 for a cell without lines."""
    low = F.coalesce(F.max(F.col("vertical_pos") + F.col("line_height")), F.lit(0))
    return lines.groupBy("cell_id").agg(F.when(low == 0, 0).otherwise(low + F.max("padding")).cast("long").alias("height"))


def object_bands(objects: DataFrame) -> DataFrame:
    """(para_id, leading, trailing): room above and below a paragraph's text that its top-and-bottom objects take.

    An object hung at the paragraph's top or above pushes from above, one further down from below.
    """
    room = F.col("v_off") + F.col("height")
    near = F.col("v_off") <= 0
    return objects.groupBy("para_id").agg(F.coalesce(F.max(F.when(near, F.greatest(room, F.lit(0)))), F.lit(0)).cast("long").alias("leading"), F.coalesce(F.max(F.when(~near, room)), F.lit(0)).cast("long").alias("trailing"))


def control_places(paragraphs: DataFrame) -> DataFrame:
    """(para_id, ctrl, place): the character before which each control stands, from the gaps of 8 units among the offsets.

    Reads text and char_offsets; units that no character explains are controls.
    """
    chars = paragraphs.select("para_id", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("place", "char"), "char_offsets")
    chars = chars.select("para_id", "place", F.element_at("char_offsets", F.col("place") + 1).alias("at"), T.utf16_width(F.col("char")).alias("width"))
    order = Window.partitionBy("para_id").orderBy("place")
    gap = F.col("at") - F.coalesce(F.lag(F.col("at") + F.col("width")).over(order), F.lit(0))
    rows = chars.withColumn("n", F.floor(gap / 8)).filter("n > 0").select("para_id", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return rows.select("para_id", (F.row_number().over(Window.partitionBy("para_id").orderBy("place", "k")) - 1).alias("ctrl"), "place")


def events_json(events: DataFrame) -> DataFrame:
    """(doc_id, json): a document's edit events, in order, as one JSON array."""
    one = F.struct("kind", "section", "para", "value")
    return events.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("e")))), lambda x: x["e"])).alias("json"))


def pages_json(items: DataFrame) -> DataFrame:
    """(doc_id, json): a document's pages with their items as one JSON array."""
    one = F.struct("block", "column", "y")
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("items"))
    return pages.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("page", "items")))).alias("json"))


def native_image(data: Column) -> Column:
    """Kind of an image by its leading bytes: png, bmp, jpg, gif, dib (a bitmap without its file header) or null."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("424D"), "bmp").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("28000000"), "dib")
