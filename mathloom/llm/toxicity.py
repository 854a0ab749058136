"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed byte n-grams (n = 4, 5 and 6) of the lower-cased text, with
every run of non-letters turned into one blank, so n-grams also know word ends. Each present
feature counts as its log-count ratio between toxic and other training texts; a logistic
regression with L2 penalty is fitted on those. A text is scored by the sum of the products
over its distinct features.

Fitting uses a bounded sample: the ``sample`` labelled documents with the smallest seeded
hashes of doc_id; of rows with one doc_id the smallest text is learned. Executors count its
features. The model has ``widest`` features, those with the most significant ratios (README has
held-out figures for other numbers); the driver holds ``TABLE`` counts, and of each text the
features in use: at most 4 * ``sample`` * ``widest`` bytes.

Defined results: null and empty texts are scored by the intercept; rows without doc_id are
scored and in no fold; repeated labels count once, the largest one; without any usable label
every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm import common

BITS = 19
TABLE = 1 << BITS
ORDERS = (4, 5, 6)
PIECE = 1 << 20
#: The sample has this many partitions however many the table has, so that few counts are added.
SAMPLE_PARTS = 24
FOLD = bytes((c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32) for c in range(256))
SEVERAL = re.compile(rb"  +")


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """The hashes of the n-grams of a UTF-8 text, in pieces; repeats are left in."""
    raw = SEVERAL.sub(b" ", b" " + raw.decode("utf-8", "replace").lower().encode().translate(FOLD) + b" ")
    for start in range(0, len(raw), PIECE):
        x = np.frombuffer(raw[start : start + PIECE + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        gram = x
        for n in range(2, max(ORDERS) + 1):
            if len(gram) < 2:
                break
            gram = gram[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            if n in ORDERS:
                yield ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def features(raw: bytes) -> np.ndarray:
    """The distinct hashes of a text's n-grams."""
    got = [np.unique(g) for g in grams(raw)]
    return np.unique(np.concatenate(got)).astype(np.int32) if got else np.zeros(0, np.int32)


def chosen(p: np.ndarray, q: np.ndarray, n1: float, n0: float, least: int = 3, widest: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """The features in use, and the log-count ratio of each, from the numbers of toxic (p) and
    other (q) texts with each feature. Features in fewer than ``least`` texts are left out; of
    the others the ``widest`` with the most significant ratios are used."""
    ratio = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))
    sure = np.abs(ratio) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    sure[p + q < least] = 0
    kept = np.sort(np.argsort(-sure, kind="stable")[:widest])
    kept = kept[sure[kept] > 0]
    return kept, ratio[kept]


def fit(rows: list[np.ndarray], y: np.ndarray, kept: np.ndarray, ratio: np.ndarray, penalty: float = 3e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights by feature hash, and the intercept; ``rows``: places in ``kept`` of each text."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    vals = ratio[cols]
    w, b = np.zeros(len(kept)), float(np.log(n1 / n0))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(which, weights=w[cols] * vals, minlength=len(rows)) + b
        g = common.sigmoid(z) - y
        gw = np.bincount(cols, weights=g[which] * vals, minlength=len(w)) / len(y) + penalty * w
        gb = g.mean()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = 1 - 0.99**t
        w -= 0.02 * (mw / (1 - 0.9**t)) / (np.sqrt(vw / fix) + 1e-6)
        b -= 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / fix) + 1e-6)
    out = np.zeros(TABLE, np.float32)
    out[kept] = w * ratio
    return out, b


CELLS = 1 << 14


def counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of label 1, and of label 0, with each feature; summed by blocks of CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, TABLE), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                n[label.as_py()][features((text.as_py() or "").encode("utf-8", "replace"))] += 1
        blocks = n.reshape(-1, CELLS)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(cells=[sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["cells"]).astype(np.int32).tobytes()])

    out = np.zeros((2 * TABLE // CELLS, CELLS), np.int64)
    for r in common.map_arrow(texts.select("label", "text"), run, "block int, cells binary").groupBy("block").applyInPandas(add, "block int, cells binary").collect():
        out[r.block] = np.frombuffer(r.cells, np.int32)
    n = out.reshape(2, TABLE)
    return n[1], n[0]


def scorer(model: tuple[np.ndarray, float] | None):
    """A function from a UTF-8 text to its probability of being toxic."""
    if model is None:
        return lambda raw: 0.0
    weights, bias = model
    used = weights != 0

    def score(raw: bytes) -> float:
        got = []
        for g in grams(raw):
            got.append(np.unique(g[used[g]]))
        z = bias + (float(weights[np.unique(np.concatenate(got))].sum(dtype=np.float64)) if got else 0.0)
        return float(common.sigmoid(z))

    return score


def train(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = 12_000, widest: int = 4000, seed: int = 29) -> tuple[np.ndarray, float] | None:
    """A model with ``widest`` features of at most ``sample`` labelled documents for which ``usable`` holds.

    Features are counted on the executors; of each text only the features in use reach the driver.
    """
    rows = common.one_label(labels, "toxic").filter(usable)
    picked = common.sample_ids(rows, sample, seed).collect()
    if not picked:
        return None
    wanted = documents.sparkSession.createDataFrame([(r.doc_id, int(r.label > 0)) for r in picked], "doc_id bigint, label int")
    texts = common.checkpointed(common.texts_of(documents, wanted, ["doc_id"]).repartition(SAMPLE_PARTS, "doc_id"))
    n1, n0 = (sum(r["count"] for r in texts.groupBy("label").count().collect() if r.label == k) for k in (1, 0))
    if n1 + n0 == 0:
        return None
    kept, ratio = chosen(*counted(texts), n1, n0, widest=widest)
    shared = documents.sparkSession.sparkContext.broadcast(kept)

    def make():
        place = np.full(TABLE, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)

        def one(raw: bytes) -> tuple[bytes]:
            own = place[features(raw)]
            return (own[own >= 0].tobytes(),)

        return one

    found = common.map_text(texts.select("doc_id", "label", "text"), "cells binary", make, keep=("doc_id", "label")).collect()
    found = sorted(found, key=lambda r: (r.doc_id, r.label, bytes(r.cells)))
    return fit([np.frombuffer(r.cells, np.int32) for r in found], np.array([r.label for r in found], np.float64), kept, ratio)


def toxicity(documents: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learned outside the held-out fold."""
    model = train(documents, labels, ~common.held_out(F.col("doc_id"), mod, rest))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda raw: (score(raw),)

    out = common.map_text(documents, "score double", make)
    return out.select("doc_id", common.held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
