"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into the shortest phrases not met before (LZ78). The set
of phrases is hashed, and the fingerprint keeps, for each of ``SLOTS`` ranges of the hash, the
smallest hash in it (one-permutation minimum hash; an empty range borrows from the next full
one, so that texts with few phrases compare too). The share of equal slots estimates the
Jaccard likeness of two phrase sets, and so how well one text compresses given the other.

Documents are compared with their neighbour in descending doc_id. Ranges of about equally many
rows are cut in the order of (doc_id, hash of the text), which only takes those two numbers; so a
doc_id that many rows have is cut by the texts' hashes. Rows that are equal in both and fill
ranges of their own are spread over them at random, as each is the other's neighbour. Then one
shuffle puts each range into a partition; its first row is also sent to the range before it,
which is all that crosses a border, so no order over the whole table is ever made in one task.

Defined results: null text counts as empty; the empty text has no phrase, its fingerprint is
all zeros, and it is like another empty text (1) and unlike any other (0). Rows without doc_id
come last; rows with the same doc_id are ordered by the hash of their text. Equal texts get equal
fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import common

SLOTS = 64
#: Rows of a range, about; with over MOST_RANGES * RANGE_ROWS rows the ranges get longer, as
#: their borders go to the driver. A range is streamed, never held.
RANGE_ROWS = 4000
MOST_RANGES = 20000


STEP = 1 << 16
FACTOR = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(3 * STEP, FACTOR, np.uint64))
    INVERSES = np.cumprod(np.full(3 * STEP, pow(FACTOR, -1, 1 << 64), np.uint64))


def parse(text: str, seen: dict[str, None], now: str = "") -> str:
    """Adds the LZ78 phrases of ``text`` to ``seen``, in order; returns the unended phrase.
    ``now`` is the one left by the text before it."""
    for c in text:
        now += c
        if now not in seen:
            seen[now] = None
            now = ""
    return now


def signature(phrases: dict[str, None]) -> np.ndarray:
    """SLOTS values of 32 bits of a set of phrases; all zeros for none."""
    if not phrases:
        return np.zeros(SLOTS, np.uint32)
    hashed = []
    some: list[str] = []
    held = 0
    for p in phrases if len(phrases) > STEP else ():
        some.append(p)
        held += len(p)
        if held > STEP:
            hashed.append(hashes(some))
            some, held = [], 0
    if some or not hashed:
        hashed.append(hashes(some or list(phrases)))
    return smallest(np.concatenate(hashed))


def hashes(phrases: list[str]) -> np.ndarray:
    """64-bit hashes of phrases: polynomials over their code points, mixed."""
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    if lengths.sum() > 2 * STEP and len(phrases) > 1:
        half = len(phrases) // 2
        return np.concatenate([hashes(phrases[:half]), hashes(phrases[half:])])
    x = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(x) > 2 * STEP:  # one phrase this long takes a text of over 8e9 characters
        return np.array([xxhash.xxh3_64_intdigest(x.tobytes())], np.uint64)
    end = np.cumsum(lengths)
    start = end - lengths
    with np.errstate(over="ignore"):
        v = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * POWERS[: len(x)])])
        h = (total[end] - total[start]) * INVERSES[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def smallest(hashed: np.ndarray) -> np.ndarray:
    hashed.sort()
    slot = (hashed >> np.uint64(58)).astype(np.int64)
    full, first = np.unique(slot, return_index=True)
    value = ((hashed[first] >> np.uint64(26)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    # an empty slot takes the value of the next full one, changed by the distance
    donor = np.searchsorted(full, np.arange(SLOTS)) % len(full)
    distance = ((full[donor] - np.arange(SLOTS)) % SLOTS).astype(np.uint32)
    return value[donor] + distance * np.uint32(0x9E3779B9)


def fingerprint(text: str) -> np.ndarray:
    seen: dict[str, None] = {}
    parse(text, seen)
    return signature(seen)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def show(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, donor: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``donor``."""
    third = len(text) // 3
    return text[: len(text) - third] + donor[:third]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, own, doc_id, text) sorted by bucket, own first, doc_id descending: each
    own row is put out as soon as its follower in the bucket is known. The last one of a bucket
    without a follower is followed by a row equal to it."""

    def met(doc_id: int | None, text: str) -> tuple:
        cut = len(text) - len(text) // 3
        seen: dict[str, None] = {}
        now = parse(text[:cut], seen)
        begun = seen.copy()
        parse(text[cut:], seen, now)
        return doc_id, text, signature(seen), cut, begun, now

    def joined(before: tuple, after: tuple) -> tuple:
        doc_id, text, sig, cut, begun, now = before
        tail = after[1][: len(text) - cut]
        parse(tail, begun, now)
        new_sig, new = signature(begun), text[:cut] + tail
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), show(sig), show(new_sig), likeness(sig, new_sig), likeness(sig, after[2])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(NAMES)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)

    held, bucket = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            out = []
            for b, own, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                if held is not None and bucket != b:
                    out.append(joined(held, held))
                    held = None
                if own or held is not None:
                    row = met(doc_id, text or "")
                    if held is not None:
                        out.append(joined(held, row))
                    held = row if own else None
                bucket = b
            yield rows(out)
    if held is not None:
        yield rows([joined(held, held)])


KEY = np.dtype([("null", np.int8), ("id", np.int64), ("hash", np.int64)])


def keys(null: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that ascend as rows follow each other: ids and hashes descend, null ids are last."""
    out = np.zeros(len(ids), KEY)
    out["null"], out["id"], out["hash"] = null, np.where(null, 0, ~ids), ~hashes
    return out


class Ranges:
    """Where rows go, of the first rows' keys of ranges.

    A key at which several ranges begin is that of rows that fill ranges: these go to as many
    buckets (at random), and the rows after them to one more. Each other key begins one bucket.
    """

    def __init__(self, heads: np.ndarray) -> None:
        self.starts, many = np.unique(heads, return_counts=True)
        self.spread = np.where(many > 1, many, 0)
        size = self.spread + 1
        self.first = np.cumsum(size) - size
        self.buckets = int(size.sum())

    def place(self, key: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The bucket of each row; ``chance`` (0 to 1) spreads equal rows."""
        at = np.maximum(np.searchsorted(self.starts, key, side="right") - 1, 0)
        spread = self.spread[at]
        any_of = np.minimum((chance * spread).astype(np.int64), spread - 1)
        return self.first[at] + np.where(self.starts[at] == key, np.maximum(any_of, 0), spread)

    def before(self, found: list[int]) -> dict[int, int]:
        """For each bucket of ``found`` whose first row another one needs, that one: the bucket
        before it, and for the first bucket the last one."""
        later = {int(f) + k for f, n in zip(self.first, self.spread, strict=True) for k in range(1, n)}
        return {b: found[i - 1] for i, b in enumerate(found) if b not in later}


def fingerprints(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row and of its edited text; see the module's text."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    light = common.checkpointed(rows.select("doc_id", "h"))
    total = light.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h"))
    ranged = light.withColumn("salt", F.rand(7)).repartitionByRange(max(1, min(total // range_rows, MOST_RANGES)), F.desc_nulls_last("doc_id"), F.desc("h"), "salt")
    heads = [r.top for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(first.alias("top")).collect()]
    ranges = Ranges(keys(np.array([not t.some for t in heads]), np.array([t.doc_id or 0 for t in heads], np.int64), np.array([t.h for t in heads], np.int64)))
    shared = spark.sparkContext.broadcast(ranges)

    @F.pandas_udf("int")
    def bucket(null: pd.Series, ids: pd.Series, hashes: pd.Series, chance: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(keys(null.to_numpy(bool), ids.to_numpy(np.int64), hashes.to_numpy(np.int64)), chance.to_numpy())).astype("int32")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("chance", F.rand(11)).withColumn("b", bucket(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "h", "chance")).drop("chance")

    tops = {r.b: r.top for r in placed(light).groupBy("b").agg(first.alias("top")).collect()}
    before = ranges.before(sorted(tops))
    wanted = spark.createDataFrame([(b, tops[b].doc_id, tops[b].h, p) for b, p in before.items()], "b int, top_id bigint, top_h bigint, prior int")
    marked = placed(rows).join(F.broadcast(wanted), "b", "left")
    here, there = (F.struct(F.col(c).alias("b"), F.lit(own).alias("own")) for c, own in (("b", True), ("prior", False)))
    is_head = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")) & F.col("prior").isNotNull()
    spread = marked.select("doc_id", "text", "h", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("p")).select("p.b", "p.own", "doc_id", "text", "h")
    ranged = spread.repartitionById(ranges.buckets, F.col("b")).sortWithinPartitions("b", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("h"), "text")
    return common.map_arrow(ranged.select("b", "own", "doc_id", "text"), walk, SCHEMA)
