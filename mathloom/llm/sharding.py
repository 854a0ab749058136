"""Sharding: minimax contiguous partition of atomic groups. DataFrame functions only.

Rows of equal text are one group and stay together; null text counts as empty. Groups stand
in the order of the md5 of their text, and are cut into ``shards`` contiguous runs so that the
largest run is as small as it can be: the smallest capacity with which a greedy filling needs
no more than ``shards`` runs is searched (sixteen capacities a round, as bisection does two),
and the greedy filling of that capacity is the cut. As the order is that of a hash, a row's
shard follows from comparing its own hash with the cuts: no join, no shuffle of texts.

The driver holds the sizes of about sqrt(groups) buckets of the order, and the groups of the
buckets where a cut may fall, each again about sqrt(groups) rows. A group of copies is one row
in all of that, however many rows it has.

``slot`` numbers the rows of a shard without gaps: rows are hashed into cells, cell counts give
each cell its first slot, and only rows of one cell are ordered together (by doc_id, then
text), so a shard is never in one task. A slot is thus the place by cell, doc_id and text. Rows
that are equal in all count as one there, with their number, and are unfolded at the end.

Defined results: null text has size 1 and the crc32 of the empty text; rows without doc_id are
placed like all others; repeated rows get different slots; an empty table gives no rows; fewer
groups than shards leave shards empty. A group larger than the even share gets a run that may
exceed it; that is then the smallest capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mathloom.llm.common import checkpointed

#: Rows of a cell, about.
CELL_ROWS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def described(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and key (md5) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", *keep, size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))


class Order:
    """The ordered group sizes, read bucket by bucket as they are needed."""

    def __init__(self, groups: DataFrame, digits: int) -> None:
        self.groups = groups
        self.digits = digits
        found = groups.groupBy(F.substring("key", 1, digits).alias("b")).agg(F.sum("size").alias("size"), F.max("size").alias("most")).orderBy("b").collect()
        self.names = [r.b for r in found]
        self.ends = list(accumulate(r.size for r in found))
        self.total = self.ends[-1] if found else 0
        self.most = max((r.most for r in found), default=0)
        self.read: dict[int, tuple[list[int], list[str]]] = {}

    def bucket(self, goal: int) -> int | None:
        """The bucket in which the running size passes ``goal``; None at the end."""
        b = bisect_right(self.ends, goal)
        return b if b < len(self.ends) else None

    def load(self, wanted: set[int]) -> None:
        new = sorted(wanted - self.read.keys())
        if not new:
            return
        rows = self.groups.filter(F.substring("key", 1, self.digits).isin([self.names[b] for b in new])).select("key", "size").orderBy("key").collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.key[: self.digits], []).append(r)
        for b in new:
            own = by[self.names[b]]
            start = self.ends[b - 1] if b else 0
            self.read[b] = (list(accumulate((r.size for r in own), initial=start))[1:], [r.key for r in own])

    def reach(self, goal: int) -> tuple[int, str]:
        """The largest running size up to ``goal``, and the key where it is reached."""
        b = self.bucket(goal)
        if b is None:
            return self.total, "g"
        ends, keys = self.read[b]
        i = bisect_right(ends, goal)
        if i:
            return ends[i - 1], keys[i - 1]
        # the bucket's first group doesn't fit: the cut is at the end of the bucket before
        return (self.ends[b - 1], self.names[b - 1] + "g") if b else (0, "")


def filled(order: Order, capacities: list[int], shards: int) -> list[list[tuple[int, str]]]:
    """For each capacity the ends of the greedy runs, all capacities a step at a time."""
    runs: list[list[tuple[int, str]]] = [[] for _ in capacities]
    for _ in range(shards):
        goals = [(r[-1][0] if r else 0) + c for r, c in zip(runs, capacities, strict=True)]
        order.load({b for g in goals if (b := order.bucket(g)) is not None})
        for r, g in zip(runs, goals, strict=True):
            r.append(order.reach(g))
    return runs


def cuts(order: Order, shards: int) -> list[str]:
    """The last key of each shard but the last, for the smallest feasible capacity."""
    low = max(order.most, -(-order.total // shards))
    high = low + order.most
    while low < high:
        step = max(1, (high - low) // 16)
        tried = sorted({*range(low, high, step)})[:17]
        good = [c for c, r in zip(tried, filled(order, tried, shards), strict=True) if r[-1][0] >= order.total]
        if good:
            high = good[0]
        bad = [c for c in tried if c < high and c not in good]
        if bad:
            low = max(bad) + 1
    return [key for _, key in filled(order, [low], shards)[0][: shards - 1]]


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (of ``described``, already checkpointed) with their shard."""
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("size")))
    n = groups.count()
    digits = max(1, round(log(max(n, 1)) / 2 / log(16)))
    ends = cuts(Order(groups, digits), shards) if n else []
    shard = F.lit(0)
    for end in ends:
        shard = shard + (F.col("key") > end).cast("int")
    return rows.withColumn("shard", shard)


def numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard."""
    names = rows.columns
    cells = max(1, total // (shards * CELL_ROWS))
    told = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key")).cast("binary"))
    rows = rows.withColumn("cell", F.conv(F.substring(told, 1, 12), 16, 10).cast("bigint") % cells)
    # rows that are equal in all, however many, are one row of the order
    same = checkpointed(rows.groupBy(*names, "cell").agg(F.count("*").alias("n")))
    counts = same.groupBy("shard", "cell").agg(F.sum("n").alias("count"))
    first = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("first"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "key", *[c for c in names if c not in ("doc_id", "key", "shard")])
    start = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = same.withColumn("start", F.coalesce(start, F.lit(0))).join(first, ["shard", "cell"])
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {CELL_ROWS}"))))
    if not same.filter(F.col("n") > CELL_ROWS).isEmpty():
        blocks = blocks.repartition("key", "block")
    at = F.col("block") * CELL_ROWS
    out = blocks.withColumn("copy", F.explode(F.sequence(at, F.least(at + CELL_ROWS, F.col("n")) - 1)))
    return out.select(*names, (F.col("first") + F.col("start") + F.col("copy")).alias("slot"))


def sharded(documents: DataFrame, shards: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, size, text_crc32, law (``bytes``), shard, slot and grown_shard of every row."""
    rows = checkpointed(described(documents, keep))
    out = numbered(assigned(rows, shards), rows.count(), shards)
    return out.select("doc_id", *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
