"""Incremental indexing: new corpus files become an append to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mathloom.operators.text import Lexer
from mathloom.plans.engine import Index


def append_batch(index_path: str, batch: DataFrame, lexer: Lexer = "eng", segment: str | None = None) -> None:
    """Adds one batch of (url, text); the first makes the index. ``segment`` names the batch: one
    that is sent again adds nothing."""
    docs = batch.filter("length(url) > 0 and length(text) > 0")
    if not docs.isEmpty():
        Index.append(index_path, docs, lexer, segment)


def follow(spark: SparkSession, source: str, index_path: str, checkpoint: str, lexer: Lexer = "eng", files_per_batch: int = 1000) -> StreamingQuery:
    """Indexes the JSON files of a folder as they come. A document is complete in one record,
    so no watermark is needed; ``availableNow`` ends when all present files are in. The segment
    of a batch has its number, so an index takes each batch of one checkpoint once."""
    rows = spark.readStream.schema("url string, text string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(source)
    return rows.writeStream.foreachBatch(lambda batch, n: append_batch(index_path, batch, lexer, f"batch{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
