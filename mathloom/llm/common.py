"""What the corpus operators share: checkpoints, seeded splits, bounded labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.plans.storage import shared_folder

#: Whitespace of the word rules: space and \t to \r.
SPACES = b" \t\n\x0b\x0c\r"
BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no
    earlier stage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``checkpointed``, after which the shuffle files of ``df`` are deleted. Else they stay until
    the driver happens to collect its garbage, and those of all steps of a query add up. If ``df``
    is used again itself, Spark makes them anew."""
    out = checkpointed(df)
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined():
        # the plan has run, so this only names its parts
        for number in shuffles(df._jdf.queryExecution().toRdd()):
            cleaner.get().doCleanupShuffle(number, True)
    return out


def shuffles(rdd) -> set[int]:  # noqa: ANN001
    """The numbers of the shuffles that a JVM RDD comes from."""
    found: set[int] = set()
    met, todo = set(), [rdd]
    while todo:
        at = todo.pop()
        if at.id() in met:
            continue
        met.add(at.id())
        behind = at.dependencies()
        for k in range(behind.size()):
            link = behind.apply(k)
            if link.getClass().getSimpleName() == "ShuffleDependency":
                found.add(link.shuffleId())
            todo.append(link.rdd())
    return found


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``. Spark bounds a batch by rows and by bytes (64 MB unless the session
    says otherwise, see ``spark.sql.execution.arrow.maxBytesPerBatch``), so long texts make
    batches of fewer rows."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Hands memory that a worker has freed back to the machine, as workers wait for more tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a part of a batch that a worker handles, and puts out, at once.
PART_ROWS = 1000


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of PART_ROWS, which share their memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True for rows of the held-out fold; rows without doc_id are in none."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(mod)) == rest, F.lit(False))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per doc_id, the largest label of repeated rows, nulls dropped."""
    kept = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return kept.groupBy("doc_id").agg(F.max("label").alias("label"))


def texts_of(documents: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``wanted`` (few rows, no more than a sample's bound) with ``text``: one text each, the
    smallest where rows repeat, so that what a sample gathers never grows with repeats."""
    found = documents.select(*on, "text").join(F.broadcast(wanted), on)
    return found.groupBy(*wanted.columns).agg(F.min("text").alias("text"))


def sample_ids(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """The ``limit`` rows of (doc_id, label) with the smallest seeded hashes of doc_id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)


def map_text(df: DataFrame, schema: str, make: Callable[[], Callable[[bytes], tuple]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df`` (columns ``keep`` and ``text``) with the text replaced by the columns that
    ``make()`` computes of its UTF-8 bytes (b"" for null); ``schema`` names those columns.

    Texts are handled one by one inside each Arrow batch, so the memory of a worker is
    that of one batch and one text.
    """
    out = df.select(*keep).schema
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in out.fields]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in parts(batches):
            texts = batch.column(len(keep)).cast(pa.binary())
            rows = [one(t.as_py() or b"") for t in texts]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(c, type=ARROW[x.strip().split(" ")[1]]) for c, x in zip(cols, schema.split(","), strict=True)],
                names=[*keep, *names],
            )

    return map_arrow(df.select(*keep, F.col("text").cast("binary").alias("text")), run, ", ".join([*kept, schema]))


ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
