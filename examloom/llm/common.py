"""What the operators share: the shared folder, written tables, and batch bounds."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Bits (their logarithm) of the bitmap that tells which rows are wanted: 8 MB in every task.
FILTER_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or, where unset on a local master (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            root = got.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="examloom-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/examloom"


_open = threading.local()


class Scratch:
    """Tables written in a scope, and which of them outlive it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._written)
        return df

    def clear(self) -> None:
        """Deletes the scope's tables but the kept ones; a store that refuses keeps them."""
        sc = self.spark.sparkContext
        for path in self.paths:
            if path not in self.kept:
                place = sc._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = [p for p in self.paths if p in self.kept]


@contextmanager
def scratch(spark: SparkSession, clear: bool = True) -> Iterator[Scratch]:
    """A scope whose tables go when it ends.  What leaves it must be kept, and depend on kept tables alone.

    With ``clear`` false they stay until the caller clears them.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    got = Scratch(spark)
    scopes.append(got)
    try:
        yield got
    finally:
        scopes.remove(got)
        if clear:
            got.clear()
        for outer in scopes[-1:]:
            outer.paths += got.paths


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for scope in _open.__dict__.get("scopes", [])[-1:]:
        scope.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch brings to a Python worker, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have, whatever the case of its own."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def in_order(df: DataFrame, *order) -> DataFrame:
    """``df`` dealt by range and sorted, with ``_part`` and ``_at``: partition and place in it.

    No row meets more rows than a partition holds, so a full order of any size can be numbered: the
    caller counts rows by ``_part`` and adds the counts before.  The frame is written, because the
    bounds of a range come from a sample.
    """
    n = partitions(df.sparkSession)
    got = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    got = got.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return written(got.drop("_id"), "ordered")


def marked(rows: DataFrame, wanted: DataFrame, key: str, hit: str = "_hit") -> DataFrame:
    """``rows`` with ``hit``: whether their key may be one of ``wanted``'s; false is certain.

    A bitmap of hashed keys goes to every task (2 ** FILTER_BITS bits, whatever the input), so most rows that do not belong need not
    cross the network; what hits is still to be joined.
    """
    place = (F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)) + 1).cast("long")
    piece, held = fresh(rows, "_piece", "_bits")
    # dealt by piece first, so that each piece of the bitmap is built in one place and no partial ones travel
    places = wanted.select(F.bitmap_bucket_number(place).alias(piece), F.bitmap_bit_position(place).alias("_bit")).repartition(piece)
    bits = places.groupBy(piece).agg(F.bitmap_construct_agg("_bit").alias(held))
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(held, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1, F.lit(False))
    return rows.withColumn(piece, F.bitmap_bucket_number(place)).join(F.broadcast(bits), piece, "left").withColumn(hit, has).drop(piece, held)


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is none of ``wanted``'s."""
    return marked(rows, wanted, key).filter("_hit").drop("_hit")
