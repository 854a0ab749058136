"""Language identification by string kernels.

A passage (``PASSAGE`` bytes of a text after lower-casing, with everything but letters turned
into blanks) is the set of its hashed byte n-grams (blended spectrum: n = 2, 3 and 4, presence
only). The kernel of two passages is the size of the common set over the geometric mean of the
sizes, and a text's kernel is the mean of its passages', so that long texts don't fill the set.
Ridge regression in that kernel, one output for each language against the rest, is fitted in the
Nystroem space of a set of landmarks. Passages are scored in blocks, by two matrix products:
presence x landmarks, then kernel x weights.

Fitting uses a bounded sample of all labelled languages: at most ``per_lang`` documents of each,
fewer where there are many languages, so that there are ``most`` in all, or one of each language
if that is more (the smallest seeded hashes of doc_id; of rows with one doc_id and language the
smallest text is learned). Of each text one passage, by the hash of the text, is learned, which
executors turn into a bit set of ``DIM`` bits, so what the driver gathers is bounded whatever
their length.

Defined results: null text, empty text and text without any letter give ``und`` with score
0; equal texts get equal results; with no labelled document every text is ``und``; columns
other than those named are ignored, and a null doc_id is kept and is in no fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mathloom.llm import common

BITS = 13
DIM = 1 << BITS
ORDERS = (2, 3, 4)
#: Passages that are scored together.
BLOCK = 256
#: Bytes of a passage; the next one overlaps it by the longest n-gram.
PASSAGE = 1 << 12
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters to lower case, other ASCII to blanks; bytes of other characters stay.
FOLD = bytes((c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32) for c in range(256))
SEVERAL = re.compile(rb"  +")


def folded(text: str) -> bytes:
    return SEVERAL.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" ")


def passages(raw: bytes) -> Iterator[bytes]:
    """The passages of a folded text; a last one that is short is part of the one before."""
    many = max(1, round(len(raw) / PASSAGE))
    for k in range(many):
        yield raw[k * PASSAGE : (k + 1) * PASSAGE + max(ORDERS) - 1 if k < many - 1 else len(raw)]


def mark(raw: bytes, row: np.ndarray) -> None:
    """Sets the entries of ``row`` (DIM of uint8) that the n-grams of a passage hash to."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    gram = x
    for n in range(2, max(ORDERS) + 1):
        if len(gram) < 2:
            break
        gram = gram[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            row[mixed >> np.uint32(32 - BITS)] = 1


def learned(text: str) -> bytes:
    """The bit set of the passage of a text that is learned."""
    raw = folded(text)
    own = list(passages(raw))
    row = np.zeros(DIM, np.uint8)
    mark(own[crc32(raw) % len(own)], row)
    return np.packbits(row).tobytes()


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # DIM x m, float32, columns scaled to length 1
    weights: np.ndarray  # m x langs: Nystroem map and ridge weights together

    def scores(self, present: np.ndarray) -> np.ndarray:
        x = present.astype(np.float32)
        size = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        return (x @ self.landmarks) / size @ self.weights


def fit(bits: list[bytes], langs: list[str], landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression on packed bit sets; every ``len/landmarks``-th text of the
    language-sorted sample is a landmark, so each language has its share of them."""
    names = sorted(set(langs))
    landmarks = max(landmarks, min(3 * len(names), 2048))
    order = sorted(range(len(langs)), key=lambda i: (langs[i], bits[i]))

    def present(some: list[int]) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(bits[i] for i in some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    picked = np.unique(np.linspace(0, len(order) - 1, min(landmarks, len(order))).astype(int))
    marks = present([order[i] for i in picked]).T.copy()
    vals, vecs = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = vals > 1e-6 * vals.max()
    root = vecs[:, good] / np.sqrt(vals[good])
    # each language weighs the same, however often it occurs in the sample
    number = {name: k for k, name in enumerate(names)}
    many = np.bincount([number[lang] for lang in langs], minlength=len(names))
    total = sum(1 / many[number[lang]] for lang in langs)
    left, right = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(names)))
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        z = (present(some) @ marks).astype(np.float64) @ root
        own = np.array([number[langs[i]] for i in some])
        y = np.full((len(some), len(names)), -1.0)
        y[np.arange(len(some)), own] = 1
        zw = z / many[own][:, None]
        left += zw.T @ z
        right += zw.T @ y
    beta = np.linalg.solve(left + ridge * total / len(names) * np.eye(len(left)), right)
    return Model(names, marks, (root @ beta).astype(np.float32))


def train(documents: DataFrame, usable: Column, per_lang: int = 500, most: int = 32_000, seed: int = 17, **options: float) -> Model | None:
    """A model of at most ``per_lang`` rows of every language, and ``most`` in all, for which
    ``usable`` holds and lang is not null."""
    rows = documents.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    langs = rows.select("lang").distinct().count()
    if not langs:
        return None
    per_lang = max(1, min(per_lang, most // langs))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    picked = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_lang)
    ids = sorted(tuple(r) for r in picked.select("doc_id", "lang").distinct().collect())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [learned(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], names=["lang", "bits"])

    wanted = documents.sparkSession.createDataFrame(ids, "doc_id bigint, lang string")
    texts = common.texts_of(documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), wanted, ["doc_id", "lang"])
    found = common.map_arrow(texts.select("lang", "text"), packed, "lang string, bits binary").collect()
    return fit([r.bits for r in found], [r.lang for r in found], **options) if found else None


def predict(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), least: float | None = None) -> DataFrame:
    """Columns ``keep``, lang_pred and score (softmax of the ridge outputs) of each row.

    With ``least``, only the rows whose language is told with that score, and only ``keep``.
    """
    fields = documents.select(*keep).schema.fields
    spec = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    told = least is None
    # a text that is kept travels once
    at_text = keep.index("text") if "text" in keep else len(keep)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judged(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model = shared.value
        total, many = np.zeros((len(texts), len(model.langs) if model else 1)), np.zeros(len(texts))
        present, owner = np.zeros((BLOCK, DIM), np.uint8), []

        def flush() -> None:
            np.add.at(total, owner, model.scores(present[: len(owner)]).astype(np.float64))
            present[: len(owner)] = 0
            owner.clear()

        for i, text in enumerate(texts):
            if text and model and LETTER.search(text):
                for part in passages(folded(text)):
                    mark(part, present[len(owner)])
                    owner.append(i)
                    many[i] += 1
                    if len(owner) == BLOCK:
                        flush()
        if owner:
            flush()
        raw = total / np.maximum(many, 1)[:, None]
        e = np.exp(3 * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        scores = np.where(many > 0, (e / e.sum(axis=1, keepdims=True))[np.arange(len(best)), best], 0.0)
        return [model.langs[b] if k else "und" for b, k in zip(best, many, strict=True)], scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                names, scores = judged(batch.column(at_text).to_pylist())
                kept = batch.columns[: len(keep)]
                if told:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays(kept, names=list(keep)).filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    own = documents.select(*keep) if "text" in keep else documents.select(*keep, "text")
    return common.map_arrow(own, run, ", ".join(spec + (["lang_pred string", "score double"] if told else [])))


def language(documents: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned outside the held-out fold."""
    model = train(documents, ~common.held_out(F.col("doc_id"), mod, rest))
    out = predict(documents, model)
    return out.select("doc_id", common.held_out(F.col("doc_id"), mod, rest).alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least: float = 0.3, mod: int = 4, rest: int = 2) -> DataFrame:
    """Rows whose language is told with a score of ``least`` or more, all columns as they were."""
    model = train(documents, ~common.held_out(F.col("doc_id"), mod, rest))
    return predict(documents, model, tuple(documents.columns), least)
