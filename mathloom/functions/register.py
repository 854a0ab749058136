"""The engine's functions for SQL, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import snippets, tex
from mathloom.functions.mnc import mnc_score

PARSED = "code int, message string, n_lr int, paths array<struct<path_id int, kind string, symbol int, path string>>"


@lru_cache(1 << 14)
def _parsed(formula: str) -> dict:
    p = tex.parse(formula)
    return {"code": p.code, "message": p.message, "n_lr": p.n_lr, "paths": [{"path_id": x.path_id, "kind": x.kind, "symbol": x.symbol, "path": x.key} for x in p.paths]}


def _tex_parse(formulae: pa.Array) -> pa.Array:
    paths = pa.list_(pa.struct([("path_id", pa.int32()), ("kind", pa.string()), ("symbol", pa.int32()), ("path", pa.string())]))
    kind = pa.struct([("code", pa.int32()), ("message", pa.string()), ("n_lr", pa.int32()), ("paths", paths)])
    return pa.array([None if f is None else _parsed(f) for f in formulae.to_pylist()], kind)


def _mnc_score(symbols: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or r is None else mnc_score(list(q), [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in r]) for q, r in zip(symbols, found, strict=True)], dtype="Int32")


def _snippet(texts: pd.Series, occurs: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else snippets.highlighted(t, [] if o is None else list(o)) for t, o in zip(texts, occurs, strict=True)], dtype=object)


def snippet_of(text: Column, occurs: Column) -> Column:
    """The highlighted snippet of a text whose tokens at positions ``occurs`` are hits."""
    return F.pandas_udf(_snippet, "string")(text, occurs)


def register(spark: SparkSession) -> None:
    """``tex_parse(tex)``, ``mnc_score(query symbols, relevance)`` and ``snippet(text, occurs)``."""
    spark.udf.register("tex_parse", F.arrow_udf(_tex_parse, PARSED))
    spark.udf.register("mnc_score", F.pandas_udf(_mnc_score, "int"))
    spark.udf.register("snippet", F.pandas_udf(_snippet, "string"))
