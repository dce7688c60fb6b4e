"""Lookups that a document toolkit does by index become equi-joins: images, style catalogs, references, fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def images(controls: DataFrame, bin_data: DataFrame) -> DataFrame:
    """(doc_id, node_id, bin_id, uri): pictures that have data, in document order, as data URIs."""
    pics = controls.filter("kind = 'picture'").join(bin_data, "bin_id")
    return pics.select("doc_id", "node_id", "bin_id", T.data_uri(F.col("data").cast("binary"), F.col("ext")).alias("uri"))


def resolve_borders(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """(table_id, cell_idx, style): border of each cell by its 1-based id; 0 or unknown ids get the default."""
    return cells.join(borders.withColumnRenamed("id", "border_fill_id"), "border_fill_id", "left").select("table_id", "cell_idx", F.coalesce("style", F.lit("none")).alias("style"))


def merge_catalog(template: DataFrame, source: DataFrame, value: list[str]) -> DataFrame:
    """(id, new_id, added): where each source entry lands in the template's catalog.

    Entries with equal values take the template's first such id; new values are appended once, in the order of their first id.
    """
    have = template.groupBy(*value).agg(F.min("id").alias("have"))
    size = template.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("size"))
    entries = source.join(have, value, "left")
    new = entries.filter("have is null").groupBy(*value).agg(F.min("id").alias("first"))
    new = new.withColumn("turn", F.row_number().over(Window.orderBy("first")) - 1)  # a catalog, not documents: a few thousand rows
    out = entries.join(new.select(*value, "turn"), value, "left").join(F.broadcast(size))
    return out.select("id", F.coalesce("have", F.col("size") + F.col("turn")).cast("long").alias("new_id"), F.col("have").isNull().alias("added"))


def remap(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``column`` sent through (id, new_id); ids without an entry stay."""
    names = ids.select(F.col("id").alias("_old"), F.col("new_id").alias("_new"))
    return rows.join(names, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def dangling(refs: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """(kind, ref, uses): references that the catalog lacks; empty means intact."""
    missing = refs.join(catalog.select(F.col("id").alias("ref")), "ref", "left_anti")
    return missing.groupBy("ref").agg(F.count("*").alias("uses")).select(F.lit(kind).alias("kind"), "ref", "uses")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, value): what only one of two one-column frames has; empty means equal."""
    x, y = a.toDF("value").distinct(), b.toDF("value").distinct()
    return x.exceptAll(y).select(F.lit("left").alias("side"), "value").unionByName(y.exceptAll(x).select(F.lit("right").alias("side"), "value"))


def required_faces(uses: DataFrame) -> DataFrame:
    """(doc_id, face) without repeats."""
    return uses.filter("face is not null and face <> ''").select("doc_id", "face").distinct()


def missing_faces(required: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(face, file): required faces whose file is not present, one row a file; faces outside the manifest as unregistered."""
    faces = required.select("face").distinct()
    listed = faces.join(manifest, "face").join(present, "file", "left_anti").groupBy("file").agg(F.min("face").alias("face")).select("face", "file")
    other = faces.join(manifest, "face", "left_anti").select("face", F.lit("(미등록)").alias("file"))
    return listed.unionByName(other)


def slot_modes(uses: DataFrame) -> DataFrame:
    """(atom, para_shape_id, style_id, n): the most common style of each atom; ties go to the smaller ids."""
    counts = uses.groupBy("atom", "para_shape_id", "style_id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("atom").orderBy(F.desc("n"), "para_shape_id", "style_id")
    return counts.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def count_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, kind, before, after) of kinds whose counts differ between two control tables: a round trip that lost something."""
    x = a.groupBy("doc_id", "kind").agg(F.count("*").alias("before"))
    y = b.groupBy("doc_id", "kind").agg(F.count("*").alias("after"))
    both = x.join(y, ["doc_id", "kind"], "full_outer").na.fill(0, ["before", "after"])
    return both.filter("before <> after")


def unit_stats(members: DataFrame) -> DataFrame:
    """One row per unit (doc_id, unit_no) of its controls: counts by kind, and pictures' bin ids, z-orders and wrap modes in order."""
    pic = F.col("kind") == "picture"

    def listed(value, kind: str):
        return F.transform(F.array_sort(F.collect_list(F.when(pic, F.struct("node_id", value.alias("v"))))), lambda x: x["v"].cast(kind))

    return members.groupBy("doc_id", "unit_no").agg(
        F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(pic).alias("pictures"), F.count_if(F.col("kind") == "equation").alias("equations"),
        F.count_if(pic & ~F.col("treat_as_char")).alias("floating_pictures"), F.count_if(pic & F.col("treat_as_char")).alias("inline_pictures"),
        F.array_join(listed(F.col("bin_id"), "string"), ",").alias("picture_bin_data_ids"), F.array_join(listed(F.col("z_order"), "string"), ",").alias("picture_z_orders"),
        F.array_join(listed(T.lookup(F.col("text_wrap"), T.WRAPS), "string"), ",").alias("picture_wrap_modes"),
    )
