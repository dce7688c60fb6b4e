"""The stages of the corpus pipeline; each calls one operator on all documents that its predecessor kept.

A stage's result must be written before the next stage begins (``run`` does so): the next one deletes the working tables of
those before it in its thread, so the shared folder holds one stage's at a time.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns that ``docs`` has.  A null or empty text
passes through or goes as the stage's operator defines it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, line_dedup, near_dup, quality
from .common import fresh, scratch, shared_dir, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left = threading.local()


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scope in _left.__dict__.pop("scopes", []):
            if scope.spark.sparkContext is spark.sparkContext:
                scope.clear()
        with scratch(spark, clear=False) as scope:
            out = f(spark, docs, sf_dir)
        _left.scopes = [scope]
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@_stage
def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs, n_chars as the text now is; one that lost every line goes."""
    n_lines, dropped = fresh(docs, "_n_lines", "_n_dropped")
    out = line_dedup.dedup_lines(docs, counts=(n_lines, dropped))
    out = out.filter((F.col(dropped) == 0) | F.col("text").rlike(line_dedup.WORD))
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_dup.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@_stage
def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether the ids decode to the bytes of the text."""
    return byte_bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decodes="decodes")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return docs
