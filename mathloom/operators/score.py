"""Scores: BM25, proximity, formulae, and their sum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mathloom.functions import tex
from mathloom.functions.mnc import mnc_score
from mathloom.operators.merge import suffix_division

K1, B = 1.5, 0.75
MATCH_WEIGHT = 10000
MAX_OCCURS = 8


def bm25(tf: Column, idf: Column, doc_len: Column, avg_len: Column, frac: str = "k1") -> Column:
    """One term's part. The length factor is k1 / average length (Q2); ``frac="b"`` gives the
    textbook's b / average length."""
    per = F.lit(K1 if frac == "k1" else B) / avg_len
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + per * doc_len))


def min_distance(positions: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, dist) of rows (by, list_id, pos): the smallest gap between neighbours of the merged
    positions that come from different lists and differ; null if there is none."""
    w = Window.partitionBy(by).orderBy("pos", "list_id")
    rows = positions.select(by, "pos", "list_id", F.lag("pos").over(w).alias("p"), F.lag("list_id").over(w).alias("l"))
    apart = (F.col("p") != F.col("pos")) & (F.col("l") != F.col("list_id"))
    return rows.groupBy(by).agg(F.min(F.when(apart, F.col("pos") - F.col("p"))).alias("dist"))


def merged(lists: Column) -> Column:
    """The positions of lists (list_id, pos: array) of one document as sorted (pos, list_id)."""
    return F.sort_array(F.flatten(F.transform(lists, lambda x: F.transform(x["pos"], lambda p: F.struct(p.alias("pos"), x["list_id"].alias("list_id"))))))


def nearest(places: Column) -> Column:
    """``min_distance`` of one document's merged positions."""

    def gap(s: Column) -> Column:
        def one(i: Column) -> Column:
            a, b = F.get(s, i - 1), F.get(s, i)
            return F.when((a["pos"] != b["pos"]) & (a["list_id"] != b["list_id"]), b["pos"] - a["pos"])

        return F.when(F.size(s) > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), one)))

    return F.get(F.transform(F.array(places), gap), F.lit(0))


def first_places(places: Column) -> Column:
    """``occurrences`` of one document's merged positions."""
    return F.slice(F.array_distinct(F.transform(places, lambda x: x["pos"])), 1, MAX_OCCURS)


def proximity(dist: Column) -> Column:
    return F.log(F.lit(0.3) + F.coalesce(F.exp(-dist), F.lit(0.0)))


def occurrences(positions: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, occurs): the first MAX_OCCURS distinct positions."""
    return positions.groupBy(by).agg(F.slice(F.array_sort(F.collect_set("pos")), 1, MAX_OCCURS).alias("occurs"))


def kept(total: Column) -> Column:
    """A score to nine places, so that ties don't hang on the order of summation."""
    return F.round(total, 9)


class MathQuery:
    """A formula prepared for search: its paths without inner nodes, by size of the group of
    equal symbols (large first), then symbol; equal paths are one element."""

    def __init__(self, formula: str) -> None:
        self.parsed = tex.parse(formula)
        if self.parsed.code != tex.OK:
            raise ValueError(f"not a formula: {self.parsed.message}")
        own = [p for p in self.parsed.paths if p.kind != "gener"]
        count: dict[int, int] = {}
        for p in own:
            count[p.symbol] = count.get(p.symbol, 0) + 1
        own.sort(key=lambda p: (-count[p.symbol], p.symbol))
        self.symbols = [p.symbol for p in own]
        self.elements: dict[tuple[str, str], list[int]] = {}
        for i, p in enumerate(own, 1):
            # Q8: wildcards look among inner nodes
            self.elements.setdefault(("token" if p.kind == "normal" else "gener", p.key), []).append(i)
        self.n_lr = self.parsed.n_lr

    def rows(self) -> list[tuple[int, str, str]]:
        return [(i, cls, prefix) for i, (cls, prefix) in enumerate(self.elements)]


def expression_scores(prefixes: DataFrame, formula: str) -> DataFrame:
    """(doc_id, exp_id, suffix, level, score) of the formulae that contain ``formula``: the
    mark-and-cross score over 1 + depth + surplus leaves, whole numbers; zeros are left out."""
    query = MathQuery(formula)
    spark = prefixes.sparkSession
    table = spark.createDataFrame(query.rows(), "element int, cls string, prefix string")
    symbols, own = query.symbols, list(query.elements.values())

    def marks(found: pa.Array) -> pa.Array:
        # equal formulae have equal rows, which are scored once in a batch
        flat = found.flatten()
        rows = np.ascontiguousarray(np.stack([flat.field(name).to_numpy().astype(np.int32) for name in ("symb", "path_id", "element")], axis=1))
        ends = np.cumsum(found.value_lengths().to_numpy())
        known: dict[bytes, int] = {}
        out = np.zeros(len(ends), np.int32)
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            key = rows[a:b].tobytes()
            if key not in known:
                known[key] = mnc_score(symbols, [(symb, path_id, own[element]) for symb, path_id, element in rows[a:b].tolist()])
            out[k] = known[key]
        return pa.array(out)

    marks = F.arrow_udf(marks, "int")
    rows = suffix_division(prefixes, table, len(own), query.n_lr).withColumn("marks", marks("found"))
    score = F.expr(f"cast(marks div (level + n_lr - {query.n_lr} + 1) as bigint)")
    return rows.select("doc_id", "exp_id", "suffix", "level", score.alias("score")).filter("score > 0")


def math_lists(expressions: DataFrame) -> DataFrame:
    """(suffix, level, doc_id, score, pos): best score of a document and its first formulae."""
    first = F.slice(F.array_sort(F.collect_set("exp_id")), 1, MAX_OCCURS)
    return expressions.groupBy("suffix", "level", "doc_id").agg(F.max("score").alias("score"), first.alias("pos"))


def document_score(prox: Column, best_math: Column, bm25_sum: Column, dimension: Column) -> Column:
    """prox + (1 + math)/2 * (1 + bm25) + MATCH_WEIGHT * dimension (Q5: the sum starts at 1)."""
    return prox + (1 + best_math) / 2 * (1 + bm25_sum) + MATCH_WEIGHT * dimension
