"""Quality classifier with supervised subword embeddings.

A text is the mean of the learned vectors of its tokens' features: each word, and each byte
n-gram (n = 3 and 4) inside the word with its end marks, has a hashed vector of ``WIDTH``
numbers; the pair of a word and its repeat has one of its own. A linear layer and a softmax over the two classes follow. All are trained together
by stochastic gradient descent in numpy, on a bounded sample: the labelled documents with the
smallest seeded hashes of doc_id, at most ``sample`` of them and as many as have ``most`` cells
together (of rows with one doc_id the smallest text is learned). Executors turn them into cells
with their shares, so the driver holds at most 8 * ``most`` bytes of them, however long texts are.

Mean and linear layer commute, so for scoring each cell is one number, and a whole text
costs its hashing and one gather.

Defined results: null, empty and blank texts are scored by the bias alone; repeated labels
count once, the largest; without any usable label every score is 0.5; rows without doc_id
are scored and are in no fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm import common

BITS = 18
TABLE = 1 << BITS
WIDTH = 16
PIECE = 1 << 16
MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 1 << 64)
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(2 * PIECE + 2, MULT, np.uint64)) * np.uint64(INVERSE)
    INVERSES = np.cumprod(np.full(2 * PIECE + 2, INVERSE, np.uint64)) * np.uint64(MULT)
#: The cell of the word pair "the same word again", which has one vector for all words.
AGAIN = 0
CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most 2 * PIECE bytes, cut at blanks where there are any."""
    while len(raw) > 2 * PIECE:
        cut = raw.rfind(b" ", 1, 2 * PIECE)
        cut = cut if cut > 0 else 2 * PIECE
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def cells(raw: bytes) -> Iterator[np.ndarray]:
    """The cells of a UTF-8 text's words and n-grams, in pieces, with repeats."""
    for part in pieces(raw.translate(common.BLANK)):
        x = np.frombuffer(b" " + part + b" ", np.uint8)
        blank = x == 32
        edge = np.flatnonzero(blank)
        some = np.flatnonzero(np.diff(edge) > 1)
        if not len(some):
            continue
        with np.errstate(over="ignore"):
            total = np.cumsum(CODES[x] * POWERS[: len(x)])
            start, end = edge[some], edge[some + 1]
            word = (total[end - 1] - total[start]) * INVERSES[start]
            word ^= word >> np.uint64(31)
            cell = ((word * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int32)
            yield cell
            yield np.full(np.count_nonzero(word[1:] == word[:-1]), AGAIN, np.int32)
            y = x.astype(np.uint32)
            gram = y
            inner = np.zeros(len(x), bool)
            for n in (2, 3, 4):
                if len(x) < n:
                    break
                gram = gram[:-1] * np.uint32(0x01000193) + y[n - 1 :]
                if n > 2:
                    inner = blank[1 : len(x) - n + 2] if n == 3 else inner[:-1] | blank[2 : len(x) - 1]
                    got = (gram + np.uint32(n)) ^ (gram >> np.uint32(15))
                    yield ((got * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))[~inner].astype(np.int32)


def features(raw: bytes) -> bytes:
    """Distinct cells and their shares of the text's features, packed."""
    got = list(cells(raw))
    if not got:
        return b""
    cell, n = np.unique(np.concatenate(got), return_counts=True)
    return cell.astype(np.int32).tobytes() + (n / n.sum()).astype(np.float32).tobytes()


def fit(rows: list[bytes], y: np.ndarray, epochs: int = 8, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, float]:
    """One number for each cell (its vector times the difference of the output rows), and the bias."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (TABLE, WIDTH)).astype(np.float32)
    out = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([max((1 - y).sum(), 1), max(y.sum(), 1)]) / len(y)).astype(np.float32)
    data = [(np.frombuffer(r, np.int32, len(r) // 8), np.frombuffer(r, np.float32, len(r) // 8, len(r) // 2)) for r in rows]
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            cell, share = data[i]
            now = rate * (1 - done / steps)
            done += 1
            own = embed[cell]
            mean = share @ own
            z = mean @ out + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[int(y[i])] -= 1
            back = out @ g
            out -= now * np.outer(mean, g)
            bias -= 0.1 * now * g
            embed[cell] = own - (now * 30 * share)[:, None] * back
    return embed @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scorer(model: tuple[np.ndarray, float] | None):
    """A function from a UTF-8 text to its probability of good quality."""
    if model is None:
        return lambda raw: 0.5
    table, bias = model

    def score(raw: bytes) -> float:
        total, n = 0.0, 0
        for got in cells(raw):
            total += float(table[got].sum(dtype=np.float64))
            n += len(got)
        return float(common.sigmoid(bias + total / max(n, 1)))

    return score


def train(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = 3000, most: int = 1 << 24, seed: int = 31, **options: float) -> tuple[np.ndarray, float] | None:
    """A model of at most ``sample`` labelled documents, with at most ``most`` cells, for which
    ``usable`` holds."""
    picked = common.sample_ids(common.one_label(labels, "quality").filter(usable), sample, seed).collect()
    if not picked:
        return None
    wanted = documents.sparkSession.createDataFrame([(r.doc_id, r.label) for r in picked], "doc_id bigint, label int")
    texts = common.texts_of(documents, wanted, ["doc_id"])
    made = common.checkpointed(common.map_text(texts.select("doc_id", "label", "text"), "cells binary", lambda: lambda raw: (features(raw),), keep=("doc_id", "label")))
    sizes = {r.doc_id: r.n for r in made.select("doc_id", F.length("cells").alias("n")).collect()}
    # in the order of the sample, until the cells are too many
    held, known = 0, []
    for r in picked:
        held += sizes.get(r.doc_id, 0) // 8
        if held > most and known:
            break
        known.append(r.doc_id)
    found = made.join(F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in known], "doc_id bigint")), "doc_id").collect()
    found = sorted(found, key=lambda r: (r.doc_id, bytes(r.cells)))
    return fit([bytes(r.cells) for r in found], np.array([r.label for r in found], np.float64), **options) if found else None


def quality(documents: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learned outside the held-out fold."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, ~common.held_out(F.col("doc_id"), mod, rest)))

    def make():
        score = scorer(shared.value)
        return lambda raw: (score(raw),)

    out = common.map_text(documents, "score double", make)
    return out.select("doc_id", common.held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
