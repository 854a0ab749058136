"""Ranking and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP, PER_PAGE = 155, 10


def top_k(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best; equal scores by ascending doc_id."""
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def page_count(n: int, per_page: int = PER_PAGE) -> int:
    return -(-n // per_page)


def page_window(n: int, page: int, per_page: int = PER_PAGE) -> tuple[int, int, int]:
    """[from, to) of a page counted from 1, and the number of pages; empty if out of range."""
    pages = page_count(n, per_page)
    if not 1 <= page <= pages:
        return 0, 0, pages
    return (page - 1) * per_page, min(page * per_page, n), pages


def with_pages(hits: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Hits (few: top-k) with rank from 1 and page from 1."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("doc_id")))
    return hits.withColumn("rank", rank.cast("bigint")).withColumn("page", F.ceil(F.col("rank") / per_page).cast("bigint"))
