"""Index tables: postings, document lengths, collection statistics, formula paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions import tex as tex_functions
from mathloom.operators import text

MAX_POSITIONS = 2048
MATH_TERM = text.MATH_TERM.encode()


#: Tokens that a worker groups at once, about.
CHUNK = 1 << 17
#: Letters in lower case; other bytes are blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
TOKEN = re.compile(rb"\[imath\].*?(?:\[/imath\]|\Z)|[a-zA-Z]+", re.S)


def _terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text by the lexer "eng", as ``text.token_array`` and ``term_of``."""
    if b"[imath]" not in raw:
        return raw.translate(LETTERS).split()
    found = (t if t[:1] != b"[" else MATH_TERM if t.endswith(b"[/imath]") else None for t in TOKEN.findall(raw))
    return [t.lower() for t in found if t is not None]


def _grouped(doc_ids: pa.Array, docs: list[list]) -> pa.RecordBatch:
    """The postings of documents, given their terms in order."""
    n = np.array([len(d) for d in docs], np.int64)
    coded = pa.array([t for d in docs for t in d], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(docs)), n)
    pos = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    key = doc * max(len(coded.dictionary), 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    own = doc[order[starts]]
    kept = order[np.arange(len(key)) - np.repeat(starts, sizes) < MAX_POSITIONS]
    tf = np.minimum(sizes, MAX_POSITIONS).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(pos[kept]))
    terms = coded.dictionary.take(pa.array(codes[order[starts]])).cast(pa.string())
    return pa.RecordBatch.from_arrays([terms, doc_ids.take(pa.array(own)), pa.array(tf), lists, pa.array(n[own])], names=["term", "doc_id", "tf", "pos", "doc_len"])


def postings(docs: DataFrame, lexer: text.Lexer = "eng") -> DataFrame:
    """(term, doc_id, tf, pos, doc_len) of (doc_id, text): at most MAX_POSITIONS positions count.

    A document is one row, so its tokens are grouped by term where it is read, many documents
    at once: no token is shuffled.
    """
    plain = lexer == "eng"
    given = F.col("text").cast("binary") if plain else F.transform(text.token_array(F.col("text"), lexer), text.term_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, docs = 0, 0, []
            for at, value in enumerate(batch.column(1)):
                raw = value.as_py()
                docs.append((_terms(raw) if plain else [t.encode() for t in raw]) if raw else [])
                held += len(docs[-1])
                if held >= CHUNK:
                    yield _grouped(batch.column(0).slice(first, len(docs)), docs)
                    first, held, docs = at + 1, 0, []
            if docs:
                yield _grouped(batch.column(0).slice(first, len(docs)), docs)

    rows = docs.select("doc_id", given.alias("given"))
    return rows.mapInArrow(run, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, tf int, pos array<int>, doc_len bigint")


def term_df(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(postings_or_tokens: DataFrame) -> DataFrame:
    return postings_or_tokens.groupBy("doc_id").agg(F.count("*").alias("doc_len"))


def with_lengths(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``docs`` with doc_len; documents without tokens have 0 and still count."""
    return docs.join(doc_lengths(tokens), "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)).cast("bigint"))


def sizes(docs: DataFrame) -> DataFrame:
    """One row: doc_n, avg_doc_len (floor, 0 without documents)."""
    return docs.agg(F.count("*").alias("doc_n"), F.coalesce(F.floor(F.sum("doc_len") / F.count("*")), F.lit(0)).cast("bigint").alias("avg_doc_len"))


def stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: doc_n, avg_doc_len, term_n."""
    return sizes(docs).crossJoin(F.broadcast(postings.agg(F.countDistinct("term").alias("term_n"))))  # one row each


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


PARSED = "code int, message string, n_lr int, paths array<struct<ord int, path string, cls string, path_id int, symb int, fr_hash int>>"


PATH_KIND = pa.struct([("ord", pa.int32()), ("path", pa.string()), ("cls", pa.string()), ("path_id", pa.int32()), ("symb", pa.int32()), ("fr_hash", pa.int32())])
PARSED_KIND = pa.struct([("code", pa.int32()), ("message", pa.string()), ("n_lr", pa.int32()), ("paths", pa.list_(PATH_KIND))])
#: Formulae of a batch that are Python objects at once; beyond them a worker holds Arrow columns.
PART_ROWS = 1000


def parsed(tex: Column) -> Column:
    """The parse of a formula as a struct: code, message, n_lr, paths."""

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # formulae repeat; the last ones parsed are kept
        @lru_cache(1 << 12)
        def one(s: str) -> dict:
            p = tex_functions.parse(s)
            paths = [{"ord": i, "path": x.key, "cls": "token" if x.kind == "normal" else "gener", "path_id": x.path_id, "symb": x.symbol, "fr_hash": x.fr_hash} for i, x in enumerate(p.paths)]
            return {"code": p.code, "message": p.message, "n_lr": p.n_lr, "paths": paths}

        for batch in batches:
            made = [pa.array([], PARSED_KIND)]
            for at in range(0, len(batch), PART_ROWS):
                coded = pc.fill_null(batch.slice(at, PART_ROWS), "").dictionary_encode()
                made.append(pa.array([one(s) for s in coded.dictionary.to_pylist()], PARSED_KIND).take(coded.indices))
            yield pa.concat_arrays(made)

    parse = F.arrow_udf(parse, PARSED)
    return parse(tex)


def math_paths(formulae: DataFrame) -> DataFrame:
    """(path, cls, doc_id, exp_id, n_lr, ord, path_id, symb, fr_hash) of formulae (doc_id,
    exp_id, tex) that parse."""
    rows = formulae.select("doc_id", "exp_id", parsed(F.col("tex")).alias("p")).filter("p.code = 0")
    rows = rows.select("doc_id", "exp_id", "p.n_lr", F.explode("p.paths").alias("x"))
    return rows.select("x.path", "x.cls", "doc_id", "exp_id", "n_lr", "x.ord", "x.path_id", "x.symb", "x.fr_hash")


def math_prefixes(paths: DataFrame) -> DataFrame:
    """``paths`` with every way to cut a path into prefix, suffix and level (tokens of the
    suffix), so that prefix search is an equi-join. Inner nodes and wildcards may have an
    empty prefix."""
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    rows = paths.withColumn("parts", parts)
    cut = F.explode(F.sequence(F.when(F.col("cls") == "token", 1).otherwise(0), F.size("parts")))
    rows = rows.withColumn("cut", cut)
    join = lambda a: F.array_join(a, "/")
    return rows.select(
        join(F.slice("parts", F.lit(1), F.col("cut"))).alias("prefix"), "cls", join(F.slice("parts", F.col("cut") + 1, F.size("parts"))).alias("suffix"), (F.size("parts") - F.col("cut")).alias("level"),
        "doc_id", "exp_id", "n_lr", "ord", "path_id", "symb", "fr_hash",
    )


def doc_formulae(docs: DataFrame, lexer: text.Lexer = "eng") -> DataFrame:
    """``formulae`` of (doc_id, text); texts without one are not cut into tokens."""
    return formulae(text.tokens(docs.filter(F.col("text").contains("[imath]")), lexer=lexer))


def formulae(tokens: DataFrame) -> DataFrame:
    return tokens.filter("tex is not null").select("doc_id", F.col("pos").alias("exp_id"), "tex")


def parse_counts(formulae: DataFrame) -> DataFrame:
    """One row: formulae parsed, and how many of them failed."""
    return formulae.select(parsed(F.col("tex")).alias("p")).agg(F.count("*").alias("n_parse_tex"), F.coalesce(F.sum((F.col("p.code") == 1).cast("int")), F.lit(0)).alias("n_parse_err"))
