"""A paper for each unit: its paragraphs as a body of their own, with the catalogs of the paper it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.papers import part
from ..session import stored
from ..sources.schema import CATALOGS, PARTS
from .questions import units


def _by_node(columns: list[str]) -> Column:
    """Aggregate: rows of ``columns`` by node, pieces of one paragraph by their place; the comparison reads nothing else, as maps have no order."""
    keys = [k for k in ("node_id", "para_idx") if k in columns]

    def compare(a: Column, b: Column) -> Column:
        x, y = (F.struct(*(r[k].alias(k) for k in keys)) for r in (a, b))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.array_sort(F.collect_list(F.struct(*columns)), compare)


def split_papers(papers: DataFrame) -> DataFrame:
    """Rows like those of ``papers``, one per unit; path ends in ``_qNN`` by the unit's place, preview_text is its label.

    A paragraph cut at its block tables keeps the items of its slice; what is nested in them comes along.  Only data that the
    unit's pictures name is kept, and no extra streams.
    """
    papers = stored(papers, "papers")
    members = stored(units(papers), "members")
    key = ["doc_id", "unit_no"]
    hosts = part(papers, "controls").select("doc_id", F.col("node_id").alias("ctrl"), F.col("end_node_id").alias("ctrl_end"))
    held = members.select(*key, F.explode("ctrls").alias("ctrl")).join(hosts, ["doc_id", "ctrl"])
    inside = held.select(*key, F.explode(F.sequence("ctrl", "ctrl_end")).alias("node_id")).distinct()
    rows = part(papers, "paragraphs")
    names = [c for c in rows.columns if c != "doc_id"]
    own = members.select(*key, F.col("node_id"), F.col("para_idx").alias("_idx"), "first_item", "last_item", F.col("text").alias("_text"))
    body = rows.join(own, ["doc_id", "node_id"])
    kept = F.filter("items", lambda i, at: (at >= F.col("first_item")) & (at <= F.col("last_item")))
    body = body.withColumn("items", kept).withColumn("text", F.col("_text")).withColumn("para_idx", F.col("_idx")).withColumn("container", F.lit("body")).withColumn("parent_node_id", F.lit(None).cast("long")).withColumn("section_idx", F.lit(0))
    nested = rows.join(inside, ["doc_id", "node_id"]).withColumn("section_idx", F.lit(0))
    every = body.select(*key, *names).unionByName(nested.select(*key, *names))
    out = every.groupBy(*key).agg(_by_node(names).alias("paragraphs"))
    for name in ("controls", "cells"):
        table = part(papers, name)
        cols = [c for c in table.columns if c != "doc_id"]
        out = out.join(table.join(inside, ["doc_id", "node_id"]).groupBy(*key).agg(_by_node(cols).alias(name)), key, "left")
    label = members.select(*key, "label").distinct()
    rest = [c for c in papers.columns if c not in (*PARTS, "path", "preview_text", "section_count") or c in (*CATALOGS, "bin_data")]
    out = out.join(label, key).join(papers.select(*rest, F.col("path").alias("_path")), "doc_id")
    types = {f.name: f.dataType for f in papers.schema.fields}
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("unit_no"))
    out = out.withColumn("path", F.format_string("%s_q%02d", F.regexp_replace("_path", r"\.[^./]*$", ""), place))
    used = F.transform(F.filter("controls", lambda c: c["kind"] == "picture"), lambda c: c["bin_data_id"])
    out = out.withColumn("bin_data", F.filter("bin_data", lambda b: F.array_contains(F.coalesce(used, F.array().cast("array<int>")), b["bin_id"])))
    out = out.withColumn("preview_text", F.col("label")).withColumn("section_count", F.lit(1)).withColumn("extra_streams", F.lit(None)).withColumn("doc_id", F.md5(F.col("path").cast("binary")))
    return out.select(*((F.coalesce(F.col(n), F.array().cast(t)) if t.typeName() == "array" else F.col(n)).cast(t).alias(n) for n, t in types.items()), "label")

