"""Text to tokens: words and formulae share one count of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMULA = r"\[imath\].*?(?:\[/imath\]|\z)"
WORD = "[a-zA-Z]+"
#: "eng": runs of letters. "mix": also each character outside ASCII, for text without blanks.
LEXERS = {"eng": f"(?s){FORMULA}|{WORD}", "mix": rf"(?s){FORMULA}|{WORD}|[^\x00-\x7F]"}
#: A lexer's name, or a function from a text to its tokens as they stand in it, in order.
Lexer = str | Callable[[str], list[str]]
#: The term that stands for a formula in the term index.
MATH_TERM = "math_exp"


def _is_formula(token: Column) -> Column:
    return token.startswith("[imath]") & token.endswith("[/imath]")


def token_array(text: Column, lexer: Lexer = "eng") -> Column:
    """Tokens as they stand in the text. A formula that is never closed gives none."""
    if callable(lexer):

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lexer)

        found = cut(F.coalesce(text, F.lit("")))
    else:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEXERS[lexer]), F.lit(0))
    return F.filter(found, lambda t: ~t.startswith("[imath]") | t.endswith("[/imath]"))


def n_tokens(text: Column, lexer: Lexer = "eng") -> Column:
    """The number of tokens."""
    whole = F.size(token_array(text, lexer))
    if lexer != "eng":
        return whole
    return F.when(text.contains("[imath]"), whole).otherwise(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))))


def term_of(token: Column) -> Column:
    return F.when(_is_formula(token), MATH_TERM).otherwise(F.lower(token))


def strip_tags(formula: Column) -> Column:
    return F.regexp_replace(formula, r"^\[imath\]|\[/imath\]$", "")


def formula_text(formula: Column) -> Column:
    """Printable ASCII of a formula; line ends count as blanks (Q9, lenient form)."""
    return F.regexp_replace(F.translate(strip_tags(formula), "\n\r\t", "   "), r"[^\x20-\x7E]", "")


def tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lexer: Lexer = "eng") -> DataFrame:
    """(doc_id, pos, term, tex): one row for each token; ``tex`` only for formulae, whose term
    is MATH_TERM, so that positions stay in step (P6, Q10)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(token_array(F.col(text), lexer)).alias("pos", "t"))
    return rows.select("doc_id", "pos", term_of(F.col("t")).alias("term"), F.when(_is_formula(F.col("t")), formula_text(F.col("t"))).alias("tex"))


def token_offsets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lexer: Lexer = "eng") -> DataFrame:
    """(doc_id, pos, token, offset): the byte at which each token starts."""
    gaps = F.split(F.coalesce(F.col(text), F.lit("")), LEXERS[lexer], -1)
    both = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LEXERS[lexer]), F.lit(0)).alias("token"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(both).alias("pos", "p")).select("doc_id", "pos", F.octet_length("p.gap").alias("gap"), F.col("p.token").alias("token"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.octet_length("token"), F.lit(0))).over(before), F.lit(0)) + F.col("gap")
    return rows.withColumn("offset", start.cast("bigint")).filter("token is not null").select("doc_id", "pos", "token", "offset")


def title(text: Column) -> Column:
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("No title available.")


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")
