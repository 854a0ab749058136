"""The driver's queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mathloom.llm import decontaminate, fingerprints, jaccard, langid, mixing, pii, quality, secrets, sharding, sql, toxicity
from mathloom.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: langid.language(documents(s, d)),
        "op2_pii": lambda s, d: pii.pseudonyms(documents(s, d)),
        "op3_toxicity": lambda s, d: toxicity.toxicity(documents(s, d), labels(s, d)),
        "op4_fingerprints": lambda s, d: fingerprints.fingerprints(documents(s, d)),
        "op5_secrets": lambda s, d: secrets.secrets(documents(s, d)),
        "op6_mixing": lambda s, d: mixing.mixture(documents(s, d)),
        "op7_ngram_jaccard_join": lambda s, d: jaccard.near_duplicates(documents(s, d)),
        "op8_quality": lambda s, d: quality.quality(documents(s, d), labels(s, d)),
        "op9_decontamination": lambda s, d: decontaminate.leaks(documents(s, d), benchmark(s, d)),
        "op10_sharding": lambda s, d: sharding.sharded(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
