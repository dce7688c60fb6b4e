"""Edits of paragraphs and tables as expressions: each takes the paragraph's arrays and returns new ones; nothing is changed in place.

Places are character places; ``char_offsets`` give the units of each, and run styles move with the text they stand before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def unit_at(offsets: Column, at: Column, end: Column) -> Column:
    """Units before character ``at``; ``end`` past the last."""
    return F.coalesce(F.try_element_at(offsets, (at + 1).cast("int")), end)


def end_units(text: Column, offsets: Column) -> Column:
    """Units of the whole text."""
    last = F.try_element_at(offsets, F.lit(-1))
    return F.coalesce(last + T.utf16_width(F.right(text, F.lit(1))), F.lit(0))


def offsets_of(text: Column) -> Column:
    """Offsets of a text without controls."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    made = F.aggregate(chars, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("all")), lambda s, c: F.struct((s["at"] + T.utf16_width(c)).cast("long").alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))
    return made["all"]


def insert_text(df: DataFrame, at: Column, new: Column) -> DataFrame:
    """``df`` with ``new`` put in before character ``at``; runs that start later move on."""
    end = end_units(F.col("text"), F.col("char_offsets"))
    start, room = unit_at(F.col("char_offsets"), at, end), T.utf16_length(new).cast("long")
    runs = F.transform("char_shapes", lambda c: F.struct(F.when((c["start_pos"] >= start) & (c["start_pos"] > 0), c["start_pos"] + room).otherwise(c["start_pos"]).alias("start_pos"), c["char_shape_id"].alias("char_shape_id")))
    before, after = F.slice("char_offsets", F.lit(1), at), F.slice("char_offsets", at + 1, F.size("char_offsets"))
    offsets = F.concat(before, F.transform(offsets_of(new), lambda o: o + start), F.transform(after, lambda o: o + room))
    text = F.concat(F.left(F.col("text"), at), new, F.substring(F.col("text"), at + 1, F.lit(1 << 30)))
    return df.withColumns({"char_shapes": runs, "char_offsets": offsets, "text": text})


def delete_text(df: DataFrame, at: Column, n: Column) -> DataFrame:
    """``df`` without ``n`` characters from ``at``; runs inside the gap collapse to its start, the last of them staying."""
    end = end_units(F.col("text"), F.col("char_offsets"))
    a, b = unit_at(F.col("char_offsets"), at, end), unit_at(F.col("char_offsets"), at + n, end)
    moved = F.transform("char_shapes", lambda c: F.struct(F.when(c["start_pos"] >= b, c["start_pos"] - (b - a)).when(c["start_pos"] > a, a).otherwise(c["start_pos"]).alias("start_pos"), c["char_shape_id"].alias("char_shape_id")))
    offsets = F.concat(F.slice("char_offsets", F.lit(1), at), F.transform(F.slice("char_offsets", at + n + 1, F.size("char_offsets")), lambda o: o - (b - a)))
    text = F.concat(F.left(F.col("text"), at), F.substring(F.col("text"), at + n + 1, F.lit(1 << 30)))
    made = df.withColumns({"_moved": moved, "_offsets": offsets, "_text": text})  # apart, as names inside lambdas would bind to the new columns
    runs = F.filter("_moved", lambda c, i: (i + 1 == F.size("_moved")) | (F.try_element_at("_moved", i + 2)["start_pos"] != c["start_pos"]))
    new = {"char_shapes": runs, "char_offsets": F.col("_offsets"), "text": F.col("_text")}
    return made.select(*((new[c] if c in new else F.col(c)).alias(c) for c in df.columns))


def split_at(df: DataFrame, at: Column) -> DataFrame:
    """Two rows for each paragraph (half 0 and 1): the text before and from ``at``, the second with the run in force there."""
    end = end_units(F.col("text"), F.col("char_offsets"))
    cut = unit_at(F.col("char_offsets"), at, end)
    earlier = F.filter("char_shapes", lambda c: c["start_pos"] < cut)
    force = F.coalesce(F.try_element_at(F.filter("char_shapes", lambda c: c["start_pos"] <= cut), F.lit(-1))["char_shape_id"], F.lit(0).cast("long"))
    later = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start_pos"), force.alias("char_shape_id"))), F.transform(F.filter("char_shapes", lambda c: c["start_pos"] > cut), lambda c: F.struct((c["start_pos"] - cut).alias("start_pos"), c["char_shape_id"].alias("char_shape_id"))))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.left(F.col("text"), at).alias("text"), F.slice("char_offsets", F.lit(1), at).alias("char_offsets"), earlier.alias("char_shapes")),
        F.struct(F.lit(1).alias("half"), F.substring(F.col("text"), at + 1, F.lit(1 << 30)).alias("text"), F.transform(F.slice("char_offsets", at + 1, F.size("char_offsets")), lambda o: o - cut).alias("char_offsets"), later.alias("char_shapes")),
    )
    keep = [c for c in df.columns if c not in ("text", "char_offsets", "char_shapes")]
    return df.select(*keep, F.inline(halves))


def merge(df: DataFrame, text: Column, offsets: Column, shapes: Column) -> DataFrame:
    """``df`` with a second paragraph's text, offsets and runs put behind its own; an empty text changes nothing.

    A run of the second goes if the run before it has its place and style.
    """
    end, own = end_units(F.col("text"), F.col("char_offsets")), F.size("char_shapes")
    moved = F.transform(shapes, lambda c: F.struct((c["start_pos"] + end).cast("long").alias("start_pos"), c["char_shape_id"].alias("char_shape_id")))
    made = df.withColumns({"_own": own, "_runs": F.concat("char_shapes", moved), "_offsets": F.concat("char_offsets", F.transform(offsets, lambda o: o + end)), "_text": F.concat("text", text), "_more": text != ""})
    runs = F.filter("_runs", lambda c, i: (i < F.greatest(F.col("_own"), F.lit(1))) | (F.try_element_at("_runs", F.greatest(i, F.lit(1))) != c))
    new = {"char_shapes": runs, "char_offsets": F.col("_offsets"), "text": F.col("_text")}
    return made.select(*((F.when(F.col("_more"), new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in df.columns))


def style_range(df: DataFrame, start: Column, stop: Column, shape: Column) -> DataFrame:
    """``df`` with characters ``start`` to ``stop`` in one style: runs inside go, and the old style comes back after it."""
    end = end_units(F.col("text"), F.col("char_offsets"))
    a, b = unit_at(F.col("char_offsets"), start, end), unit_at(F.col("char_offsets"), stop, end)
    back = F.coalesce(F.try_element_at(F.filter("char_shapes", lambda c: c["start_pos"] <= b), F.lit(-1))["char_shape_id"], F.lit(0).cast("long"))

    def run(at: Column, of: Column) -> Column:
        return F.struct(at.cast("long").alias("start_pos"), of.cast("long").alias("char_shape_id"))

    runs = F.concat(F.filter("char_shapes", lambda c: c["start_pos"] < a), F.array(run(a, shape)), F.when(b < end, F.array(run(b, back))).otherwise(F.expr("cast(array() as array<struct<start_pos:bigint,char_shape_id:bigint>>)")), F.filter("char_shapes", lambda c: c["start_pos"] > b))
    return df.withColumn("char_shapes", F.when(a < b, runs).otherwise(F.col("char_shapes")))


def split_cell(cells: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """Cells with the one at (row, col) cut into ``rows`` x ``cols`` of its spans; the text stays in the first."""
    here = (F.col("cell_row") == row) & (F.col("cell_col") == col)
    parts = cells.filter(here).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("i"))
    r, c = F.floor(F.col("i") / cols), F.col("i") % cols
    down, across = F.greatest(F.floor(F.col("row_span") / rows), F.lit(1)), F.greatest(F.floor(F.col("col_span") / cols), F.lit(1))
    made = parts.select("table_id", (F.col("cell_row") + r * down).alias("cell_row"), (F.col("cell_col") + c * across).alias("cell_col"), down.cast("long").alias("row_span"), across.cast("long").alias("col_span"), F.when(F.col("i") == 0, F.col("text")).otherwise("").alias("text"))
    return cells.filter(~here).select("table_id", F.col("cell_row").cast("long").alias("cell_row"), F.col("cell_col").cast("long").alias("cell_col"), F.col("row_span").cast("long").alias("row_span"), F.col("col_span").cast("long").alias("col_span"), "text").unionByName(made)


def transposed(cells: DataFrame) -> DataFrame:
    """Cells with rows and columns exchanged: column edits are row edits between two of these."""
    swap = {"cell_row": "cell_col", "cell_col": "cell_row", "row_span": "col_span", "col_span": "row_span"}
    return cells.select(*(F.col(swap.get(c, c)).alias(c) for c in cells.columns))
