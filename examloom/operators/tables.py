"""Tables of a paper: grids, column widths, row heights, and the predicates on tables.

Input: ``cells`` (table_id, cell_idx, cell_row, cell_col, row_span, col_span, width, height, ...) and ``grids`` (table_id, row_count,
col_count, box_height).  Spans are exploded, never scanned; every table is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .segment import ordered_text

DEFAULT_WIDTH, DEFAULT_HEIGHT = 1800, 400


def grid(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(table_id, grid_row, grid_col, cell_idx): the cell over each place; a later cell wins, places outside the flat grid are dropped.

    A place beyond the last column wraps into the next row, as a flat index does.
    """
    at = cells.join(grids.select("table_id", "row_count", "col_count"), "table_id")
    at = at.select("table_id", "cell_idx", "row_count", "col_count", "col_span", "cell_col", F.explode(F.sequence("cell_row", F.col("cell_row") + F.col("row_span") - 1)).alias("r"))
    at = at.select("table_id", "cell_idx", "row_count", "col_count", "r", F.explode(F.sequence("cell_col", F.col("cell_col") + F.col("col_span") - 1)).alias("c"))
    flat = F.col("r") * F.col("col_count") + F.col("c")
    at = at.withColumn("flat", flat).filter(F.col("flat") < F.col("row_count") * F.col("col_count"))
    at = at.groupBy("table_id", "col_count", "flat").agg(F.max("cell_idx").alias("cell_idx"))
    return at.select("table_id", F.floor(F.col("flat") / F.col("col_count")).alias("grid_row"), (F.col("flat") % F.col("col_count")).alias("grid_col"), "cell_idx")


def _extent(cells: DataFrame, grids: DataFrame, span: str, at: str, size: str, count: str, default: int) -> DataFrame:
    places = grids.filter(f"{count} > 0").select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(count) - 1).cast("long"))).alias(at))
    own = cells.filter(F.col(span) == 1).groupBy("table_id", at).agg(F.max(size).alias(size))
    return places.join(own, ["table_id", at], "left").select("table_id", at, F.coalesce(F.nullif(F.col(size), F.lit(0)), F.lit(default)).cast("long").alias(size))


def column_widths(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(table_id, cell_col, width): widest cell of one column, or a default."""
    return _extent(cells, grids, "col_span", "cell_col", "width", "col_count", DEFAULT_WIDTH)


def row_heights(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(table_id, cell_row, height): tallest cell of one row, or a default."""
    return _extent(cells, grids, "row_span", "cell_row", "height", "row_count", DEFAULT_HEIGHT)


def stored_row_heights(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(table_id, cell_row, height) filled up to the stored box height; tables without one are left out.

    A row starts at its tallest cell or content; what the box has left goes evenly to rows without a height, else to all, and the
    rest of the division to the last of them.
    """
    sized = grids.filter("box_height > 0 and row_count > 0")
    places = sized.select("table_id", "box_height", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("row_count") - 1).cast("long"))).alias("cell_row"))
    own = cells.filter("row_span = 1").groupBy("table_id", "cell_row").agg(F.max(F.greatest("height", "content")).alias("own"))
    rows = places.join(own, ["table_id", "cell_row"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    table = Window.partitionBy("table_id")
    rows = rows.withColumn("gap", F.col("box_height") - F.sum("own").over(table)).withColumn("autos", F.sum((F.col("own") == 0).cast("int")).over(table))
    rows = rows.withColumn("takes", (F.col("gap") > 0) & ((F.col("autos") == 0) | (F.col("own") == 0)))
    rows = rows.withColumn("n", F.sum(F.col("takes").cast("int")).over(table)).withColumn("last", F.max(F.when(F.col("takes"), F.col("cell_row"))).over(table))
    each = F.floor(F.col("gap") / F.greatest(F.col("n"), F.lit(1)))
    rest = F.when(F.col("cell_row") == F.col("last"), F.col("gap") - each * F.col("n")).otherwise(0)
    return rows.select("table_id", "cell_row", (F.col("own") + F.when(F.col("takes"), each + rest).otherwise(0)).cast("long").alias("height"))


def table_widths(cells: DataFrame) -> DataFrame:
    """(table_id, width): the larger of the first row's sum and the widest cell."""
    first = F.coalesce(F.sum(F.when(F.col("cell_row") == 0, F.col("width"))), F.lit(0))
    return cells.groupBy("table_id").agg(F.greatest(first, F.max("width")).alias("width"))


def choice_image_tables(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Tables of at most two rows and at least five columns with three or more choice cells and a picture."""
    marked = T.strip_control(F.col("text")).rlike(f"[{T.CHOICES}]")
    stats = cells.groupBy("table_id").agg(F.sum(marked.cast("int")).alias("markers"), F.max(F.col("has_picture").cast("int")).alias("pictures"))
    return stats.join(grids.filter("row_count <= 2 and col_count >= 5"), "table_id").filter("markers >= 3 and pictures = 1").select("table_id", "markers")


def bogi_tables(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Tables of three rows and columns or more whose text, blanks aside, names the example box."""
    whole = cells.groupBy("table_id").agg(T.compact(ordered_text(F.col("cell_idx"), T.strip_control(F.col("text")))).alias("text"))
    return whole.filter(F.col("text").contains("보기")).join(grids.filter("row_count >= 3 and col_count >= 3"), "table_id").select("table_id")


def heaviest_cells(cells: DataFrame) -> DataFrame:
    """(table_id, cell_idx, weight): the cell with most characters plus ten a control; the last on a tie."""
    weight = F.length("text") + 10 * F.col("has_picture").cast("int")
    return cells.groupBy("table_id").agg(F.max(F.struct(weight.alias("weight"), "cell_idx")).alias("m")).select("table_id", "m.cell_idx", F.col("m.weight").cast("long").alias("weight"))


def is_embedded(treat_as_char: Column, wrap: Column) -> Column:
    return treat_as_char | wrap.isin("Square", "Tight", "Through")


def merge_cells(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Cells with every cell that starts in the rectangle joined into the one at its top left, texts in order."""
    inside = F.col("cell_row").between(top, bottom) & F.col("cell_col").between(left, right)
    key = F.when(inside, F.lit(-1)).otherwise(F.col("cell_idx"))
    made = cells.groupBy("table_id", key.alias("_key")).agg(F.min("cell_idx").alias("cell_idx"), F.min("cell_row").alias("cell_row"), F.min("cell_col").alias("cell_col"), F.max("row_span").alias("row_span"), F.max("col_span").alias("col_span"), ordered_text(F.col("cell_idx"), F.col("text")).alias("text"))
    joined = F.col("_key") == -1
    return made.select(
        "table_id", "cell_idx", F.when(joined, F.lit(top)).otherwise(F.col("cell_row")).cast("long").alias("cell_row"), F.when(joined, F.lit(left)).otherwise(F.col("cell_col")).cast("long").alias("cell_col"),
        F.when(joined, F.lit(bottom - top + 1)).otherwise(F.col("row_span")).cast("long").alias("row_span"), F.when(joined, F.lit(right - left + 1)).otherwise(F.col("col_span")).cast("long").alias("col_span"), "text",
    )


def insert_row(cells: DataFrame, at: int) -> DataFrame:
    """Cells with an empty row put in before row ``at``: later cells move down, spanning ones grow, and each column gets a cell."""
    moved = cells.select(
        "table_id", F.when(F.col("cell_row") >= at, F.col("cell_row") + 1).otherwise(F.col("cell_row")).alias("cell_row"), "cell_col",
        F.when((F.col("cell_row") < at) & (F.col("cell_row") + F.col("row_span") > at), F.col("row_span") + 1).otherwise(F.col("row_span")).cast("long").alias("row_span"), F.col("col_span").cast("long").alias("col_span"), "text",
    )
    covered = cells.filter((F.col("cell_row") < at) & (F.col("cell_row") + F.col("row_span") > at)).select("table_id", F.explode(F.sequence("cell_col", F.col("cell_col") + F.col("col_span") - 1)).alias("cell_col")).distinct()
    columns = cells.select("table_id", "cell_col").distinct().join(covered, ["table_id", "cell_col"], "left_anti")
    new = columns.select("table_id", F.lit(at).cast("long").alias("cell_row"), "cell_col", F.lit(1).cast("long").alias("row_span"), F.lit(1).cast("long").alias("col_span"), F.lit("").alias("text"))
    return moved.unionByName(new)


def delete_row(cells: DataFrame, at: int) -> DataFrame:
    """Cells without row ``at``: its own cells go, spanning ones shrink, later ones move up."""
    spans = (F.col("cell_row") <= at) & (F.col("cell_row") + F.col("row_span") > at)
    kept = cells.filter(~((F.col("cell_row") == at) & (F.col("row_span") == 1)))
    return kept.select("table_id", F.when(F.col("cell_row") > at, F.col("cell_row") - 1).otherwise(F.col("cell_row")).alias("cell_row"), "cell_col", F.when(spans, F.col("row_span") - 1).otherwise(F.col("row_span")).cast("long").alias("row_span"), F.col("col_span").cast("long").alias("col_span"), "text")
