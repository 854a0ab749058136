"""Small documents with the cases that every operator must handle."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHING = ("score", "lang_pred", "held_out", "predicted", "bucket", "own", "key", "size", "shard", "slot", "cell", "node", "n", "root", "domain", "language", "origin", "tokens", "copies", "rank", "row", "row_", "h")


def documents(spark, rows):
    """Of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def odd(spark, sf, extra=()):
    """Real documents, and nulls, empty and long texts, repeated rows and ids."""
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return [
        *base,
        (9001, None, None, None),
        (9002, "", "en", "src1"),
        (9003, " \n\t", None, "src1"),
        (9004, "12345 !!", "de", None),
        (None, base[3][1], "en", "src2"),
        (None, None, None, None),
        (base[5][0], base[5][1], base[5][2], base[5][3]),
        (base[6][0], base[7][1], base[7][2], base[7][3]),
        (9005, (base[1][1] + " ") * 150, "en", "src0"),
        (9006, "One", "en", "src0"),
        (9007, "one ", "fr", "src0"),
        *extra,
    ]


def widened(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df
