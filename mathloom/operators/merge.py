"""Merging posting lists by id: union, intersection, and division by path suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("or", "and")


def merge(matched: DataFrame, op: str, n_lists: int, key: tuple[str, ...] = ("doc_id",), list_id: str = "k") -> DataFrame:
    """Keys and ``n_lists`` they are in, of rows (key, list_id, ...) of ``n_lists`` lists.

    A list without rows changes nothing for "or" and leaves nothing for "and".
    """
    if op not in OPS:
        raise ValueError(f"no such merge: {op}")
    got = matched.groupBy(*key).agg(F.count_distinct(list_id).alias("n_lists"))
    return got.filter(F.col("n_lists") == n_lists) if op == "and" else got


def suffix_division(prefixes: DataFrame, query: DataFrame, n_elements: int, n_lr: int) -> DataFrame:
    """(doc_id, exp_id, suffix, level, n_lr, found): the formulae in which, for one suffix, every
    query path followed by that suffix occurs.

    ``query``: (element, cls, prefix), at most 64 rows, which is why it may be broadcast.
    ``found``: array of (element, ord, path_id, symb) in posting order.
    """
    rows = prefixes.filter(F.col("n_lr") >= n_lr).join(F.broadcast(query), ["cls", "prefix"])
    found = F.sort_array(F.collect_list(F.struct("element", "ord", "path_id", "symb")))
    rows = rows.groupBy("doc_id", "exp_id", "suffix", "level", "n_lr").agg(F.count_distinct("element").alias("n"), found.alias("found"))
    return rows.filter(F.col("n") == n_elements).drop("n")
