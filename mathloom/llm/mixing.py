"""Mixing sources to target weights: hierarchical budgeting. DataFrame functions only.

A token budget flows down a tree of domains, languages and sources. A node's budget is split
among its children by weight; a child that has fewer tokens than its share (its tokens times
``max_epochs``) gives back the difference, which goes to its siblings by weight, as long as
any of them has tokens left. Only what a whole subtree lacks goes to the subtree's siblings:
each node's capacity is that of its leaves, so shortages are met below before above. All of it
is integer arithmetic; a split loses less than a token for each child.

A leaf with budget b and t tokens takes b div t whole epochs of its documents, and of one more
epoch a prefix: its documents in the order of md5(seed:epoch:doc_id), as long as the running
tokens stay within the rest. For a leaf's prefix, tokens are summed by the leading digits of
that hash (about sqrt(rows) cells); only the cell where the rest is passed is ordered by rows.
The prefix is then a hash limit for each leaf, and a row's copies follow from the plan of its
leaf and its own hash, so that texts are neither shuffled nor sorted.

Tokens are maximal runs of characters other than space and \\t to \\r. Defined results: null
text has no token; null lang and source are the nodes ``und`` and the empty name; null doc_id
is hashed as the empty text; rows with the same doc_id are in or out of a prefix together; a
leaf without tokens gets no budget, and its rows no copy; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mathloom.llm.common import checkpointed

TREE = ("domain", "language", "origin")
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 3, "fr": 2, "es": 2}, "origin": {}}
SEED, EPOCHS, SHARE = 11, 3, (6, 10)
#: With at most so many leaves their plan is broadcast; with more, Spark chooses the join.
BROADCAST_LEAVES = 20_000


def domain_of(source: Column) -> Column:
    """The domain of a source: one of d0 to d3, by the first digit of its md5."""
    return F.concat(F.lit("d"), F.translate(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), "0123456789abcdef", "0123012301230123"))


def keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with the tree's columns; names that clash with them are replaced."""
    return documents.withColumns({"domain": domain_of(F.col("source")), "language": F.coalesce("lang", F.lit("und")), "origin": F.coalesce("source", F.lit(""))})


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def rank_of(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def split(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``nodes`` (parent columns, level, cap, given: the parent's budget) with ``budget``:
    given is filled up by weight until each child is full or nothing is left."""
    big = "decimal(38,0)"
    at = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = at.orderBy(F.col("cap") / F.col("weight"), level)
    nodes = nodes.withColumn("weight", weight_of(level, weights))
    nodes = nodes.withColumns({"before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    nodes = nodes.withColumn("full", F.col("cap").cast("decimal(20,0)") * F.col("left").cast("decimal(18,0)") <= (F.col("given") - F.col("before")).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
    nodes = nodes.withColumns({"taken": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(at), "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(at)})
    part = F.expr(f"cast(cast(given - taken as decimal(20,0)) * cast(weight as decimal(18,0)) as {big}) div greatest(open, 1)").cast("bigint")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("before", "left", "full", "taken", "open", "weight", "given", "cap")


def budgets(leaves: DataFrame, given: int, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """Leaves (tree columns, tokens) with ``budget``."""
    parent: list[str] = []
    above = None
    for level in TREE:
        path = [*parent, level]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("cap"))
        nodes = nodes.withColumn("given", F.lit(given).cast("bigint")) if above is None else nodes.join(above.withColumnRenamed("budget", "given"), parent)
        above = split(nodes, parent, level, weights)
        parent = path
    return leaves.join(above, list(TREE))


def plan(rows: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """For each leaf: budget, whole epochs, and ``limit``, the largest hash in the prefix of
    the last epoch ("" for none). ``rows`` has the tree's columns, doc_id and tokens."""
    leaves = checkpointed(rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    total = leaves.agg(F.sum("tokens"), F.sum("n")).first()
    given = (total[0] or 0) * share[0] // share[1]
    digits = max(1, ceil(log(max(total[1] or 1, 1)) / 2 / log(16)))
    made = budgets(leaves, given, weights, epochs)
    made = made.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("bigint"))
    made = checkpointed(made.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).drop("tokens", "n"))
    ranked = attached(rows, made).withColumn("rank", rank_of(seed, F.col("whole"))).withColumn("cell", F.substring("rank", 1, digits))
    cells = ranked.groupBy(*TREE, "cell", "rest").agg(F.sum("tokens").alias("tokens"))
    ends = F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("cell"))
    cells = cells.withColumn("end", ends).withColumn("start", F.col("end") - F.col("tokens"))
    # cells that fit wholly end at the last of them; the next one is ordered row by row
    whole = cells.filter(F.col("end") <= F.col("rest")).groupBy(*TREE).agg(F.max(F.concat("cell", F.lit("g"))).alias("limit"))
    crossed = cells.filter((F.col("end") > F.col("rest")) & (F.col("start") <= F.col("rest"))).select(*TREE, "cell", "start")
    # rows of one doc_id, however many, are one row of the order
    inside = attached(ranked, crossed, [*TREE, "cell"]).groupBy(*TREE, "start", "rest", "rank").agg(F.sum("tokens").alias("tokens"))
    running = F.col("start") + F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("rank"))
    partly = inside.withColumn("end", running).filter(F.col("end") <= F.col("rest")).groupBy(*TREE).agg(F.max("rank").alias("limit"))
    limits = whole.unionByName(partly).groupBy(*TREE).agg(F.max("limit").alias("limit"))
    return checkpointed(made.join(limits, list(TREE), "left").withColumn("limit", F.when(F.col("rest") > 0, F.coalesce("limit", F.lit(""))).otherwise("")))


def attached(rows: DataFrame, leaves: DataFrame, on: list[str] | None = None) -> DataFrame:
    few = leaves.count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, on or list(TREE))


def with_copies(rows: DataFrame, made: DataFrame, seed: int) -> DataFrame:
    rank = rank_of(seed, F.col("whole"))
    return attached(rows, made).withColumn("copies", (F.col("whole") + (rank <= F.col("limit")).cast("int")).cast("bigint"))


def mixture(documents: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, the tree's columns, tokens, copies and the leaf's budget of every row that is taken."""
    rows = checkpointed(keyed(documents.select("doc_id", "text", "lang", "source")).select("doc_id", *TREE, tokens_of(F.col("text")).alias("tokens")))
    out = with_copies(rows, plan(rows, weights, share, epochs, seed), seed)
    return out.filter("copies > 0").select("doc_id", *TREE, "tokens", "copies", F.col("budget").alias("leaf_budget"))


def mixed(documents: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows that are taken, as often as they are taken, with the columns of ``documents``."""
    rows = checkpointed(keyed(documents.select("doc_id", "text", "lang", "source")).select("doc_id", *TREE, tokens_of(F.col("text")).alias("tokens")))
    made = plan(rows, weights, share, epochs, seed)
    names = documents.columns
    # the tree's names may clash with columns of the input: these travel in a struct
    packed = documents.select(F.struct(*names).alias("row"), "doc_id", "lang", "source")
    out = with_copies(keyed(packed), made, seed).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
