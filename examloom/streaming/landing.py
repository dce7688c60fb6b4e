"""A folder where papers land, as a stream: each file is one event with all its state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.papers import RAW, parse_files, part


def landing(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Papers of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", "*.hwp*").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse_files(raw)


def store(papers: DataFrame, folder: str, checkpoint: str, parts: tuple[str, ...] = ("paragraphs", "controls", "cells")) -> StreamingQuery:
    """Appends papers and their parts under ``folder``, a batch to a subfolder of its own: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{folder}/papers/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(at)
        for p in parts:
            part(stored, p).write.mode("overwrite").parquet(f"{folder}/{p}/batch={number}")

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
