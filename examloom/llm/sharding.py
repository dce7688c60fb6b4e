"""Operator 1: weighted rendezvous sharding of stable record keys, DataFrame functions only.

Every (key, shard) pair gets a hash in (0, 1); the shard with the largest ``-weight / ln(hash)`` takes
the key.  A further shard competes with the others and can only win rows for itself, so growth
moves the fewest rows.  Slots number each shard's rows from 0 without gaps, in key order, by a
range-dealt sort and partition counts: no window ever holds a shard.

Edge cases: a null key is one key like any other and goes to one shard; a null text has no bytes, so
size 1 and crc32 0; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_order

_UNIT = float(1 << 53)


def score(key: Column, shard: int, weight: float) -> Column:
    """What ``shard`` bids for ``key``: larger wins, in proportion to ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.lit(float(weight)) / F.ln((bits + F.lit(0.5)) / F.lit(_UNIT))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, that takes ``key``; the lower one on a tie."""
    bids = [F.struct(score(key, j, w).alias("bid"), F.lit(-j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a positive weight")
    return (-F.array_max(F.array(*bids))["shard"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key."""
    return df.withColumn(shard, choose(F.col(key), weights))


def slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard, gapless from 0, by ``order``.

    Rows are dealt by ranges of (shard, order, row), the row's own number breaking ties, so neither
    a large shard nor a key with most of the rows lands in one task.
    """
    row, = fresh(df, "_row")
    placed = in_order(df.withColumn(row, F.monotonically_increasing_id()), shard, *order, row).drop(row)
    counts = placed.groupBy("_part", F.col(shard).alias("_shard")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows").withColumnRenamed("_part", "_p")
    # at most a row for each partition and shard boundary: partitions + shards rows, whatever the input
    out = placed.join(F.broadcast(starts), (F.col("_part") == F.col("_p")) & (F.col(shard) == F.col("_shard")))
    return out.withColumn(slot, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_p", "_shard", "_first", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: size, text crc32, shard, slot in the shard, and the shard with one shard more."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = assign(assign(sized, "doc_id", [1.0] * n_shards), "doc_id", [1.0] * (n_shards + 1), "grown_shard")
    out = slots(out, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
