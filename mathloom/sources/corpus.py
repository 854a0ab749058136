"""Corpus files: JSON documents in, plain text to JSON, JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are rejected.
MAX_BYTES = 16 << 20


def _records(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(url, text, path, reason) of the .json files at or below ``path``; reason is null for documents."""
    rows = spark.read.schema("url string, text string, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.select("url", "text", "_corrupt_record", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    reason = F.when(F.col("size") > max_bytes, "too large").when(F.col("_corrupt_record").isNotNull(), "not JSON").when(empty("url"), "no url").when(empty("text"), "no text")
    return rows.select("url", "text", "path", reason.alias("reason"))


def json_corpus(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(url, text) of the .json files at or below ``path``, one object each; both keys must be
    there and not empty. Hidden files are passed over; ``json_rejects`` has the others."""
    return _records(spark, path, max_bytes).filter("reason is null").select("url", "text")


def json_rejects(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, reason) of the files that ``json_corpus`` leaves out."""
    return _records(spark, path, max_bytes).filter("reason is not null").select("path", "reason")


def count_files(spark: SparkSession, path: str) -> int:
    """Corpus files below ``path``, listed without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path").count()


def text_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(url, text) of plain text files; bytes that aren't UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    url = F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/"))
    return rows.select(url.alias("url"), F.decode("content", "UTF-8").alias("text"))


def write_json(docs: DataFrame, path: str) -> None:
    docs.select("url", "text").write.json(path)
