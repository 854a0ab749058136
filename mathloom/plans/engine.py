"""The search engine: index tables on disk, and queries over them.

An index is a folder of segments and ``index.json``. Each segment has Parquet tables: docs,
postings (clustered by term), math_prefix (clustered by prefix, so that row groups without a
query's prefixes are skipped) and terms (the dictionary: the terms that no earlier segment has).
``index.json`` lists the segments that count, with the sums that queries need; it is renamed into
place last, so a write that fails leaves the index as it was, and a segment that is already
listed is not written again. One writer at a time.

A query is one plan: keyword rows (at most 24, broadcast) meet the postings, one shuffle by
formula, one by document, then the top k.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import snippets
from mathloom.operators import index, merge, rank, score, text
from mathloom.plans import storage
from mathloom.plans.query import MESSAGES, Keyword, by_df, checked, parse_request, unique

TABLES = ("docs", "postings", "math_prefix", "terms")
EMPTY = {"segments": [], "doc_n": 0, "words": 0, "term_n": 0, "last_id": 0}


@dataclass
class Index:
    """``docs``: doc_id, url, text, doc_len. ``postings``: term, doc_id, tf, pos, doc_len."""

    spark: SparkSession
    docs: DataFrame
    postings: DataFrame
    math_prefix: DataFrame
    lexer: text.Lexer = "eng"
    written: DataFrame | None = None  # the dictionary of an index on disk
    known: dict | None = None  # its index.json

    @classmethod
    def of(cls, docs: DataFrame, lexer: text.Lexer = "eng") -> Index:
        """An index in memory, of rows (doc_id, url, text)."""
        whole = docs.withColumn("doc_len", text.n_tokens(F.col("text"), lexer).cast("bigint"))
        prefixes = index.math_prefixes(index.math_paths(index.doc_formulae(docs, lexer)))
        return cls(docs.sparkSession, whole, index.postings(docs, lexer), prefixes, lexer)

    @cached_property
    def terms(self) -> DataFrame:
        """The dictionary: (term, term_id), ids from 1 without gaps."""
        return self.written if self.written is not None else numbered(self.postings.select("term").distinct(), ["term"], "term_id")

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """Number of documents, and their average length (floor; 0 without documents)."""
        if self.known is not None:
            n, words = self.known["doc_n"], self.known["words"]
            return n, words // n if n else 0
        row = index.sizes(self.docs).first()
        return row.doc_n, row.avg_doc_len

    @cached_property
    def term_n(self) -> int:
        return self.known["term_n"] if self.known is not None else self.postings.select("term").distinct().count()

    def write(self, path: str) -> None:
        """Writes the index as a new one."""
        if storage.exists(self.spark, f"{path}/index.json"):
            raise FileExistsError(f"there is an index at {path}")
        self._add(path, dict(EMPTY), "first", None)

    def _add(self, path: str, known: dict, segment: str, before: DataFrame | None) -> None:
        at = f"{path}/{segment}"
        self.docs.write.mode("overwrite").parquet(f"{at}/docs")
        # by hash: ranges would be told by making all rows once more
        self.postings.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
        self.math_prefix.repartition("cls", "prefix").sortWithinPartitions("cls", "prefix", "doc_id").write.mode("overwrite").parquet(f"{at}/math_prefix")
        read = self.spark.read.parquet
        new = read(f"{at}/postings").select("term").distinct()
        new = new if before is None else new.join(before.select("term"), "term", "left_anti")
        numbered(new, ["term"], "term_id", known["term_n"] + 1).write.mode("overwrite").parquet(f"{at}/terms")
        # sums of the new part alone
        part = read(f"{at}/docs").agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
        out = {
            "segments": [*known["segments"], segment], "doc_n": known["doc_n"] + part[0], "words": known["words"] + part[1],
            "term_n": known["term_n"] + read(f"{at}/terms").count(), "last_id": max(known["last_id"], part[2]),
        }
        storage.write_text(self.spark, f"{path}/index.json", json.dumps(out))

    @classmethod
    def open(cls, spark: SparkSession, path: str, lexer: text.Lexer = "eng") -> Index:
        if not storage.exists(spark, f"{path}/index.json"):
            raise FileNotFoundError(f"no index at {path}")
        known = json.loads(storage.read_text(spark, f"{path}/index.json"))
        docs, postings, math_prefix, terms = (spark.read.parquet(*[f"{path}/{s}/{t}" for s in known["segments"]]) for t in TABLES)
        return cls(spark, docs, postings, math_prefix, lexer, terms, known)

    @classmethod
    def append(cls, path: str, new: DataFrame, lexer: text.Lexer = "eng", segment: str | None = None) -> None:
        """Adds rows (url, text) to the index, or makes it: their doc_ids continue from the
        largest, in order of url, then text. A ``segment`` that is in the index already (a batch
        that is sent again) is not added twice."""
        spark = new.sparkSession
        old = cls.open(spark, path, lexer) if storage.exists(spark, f"{path}/index.json") else None
        known = old.known if old else dict(EMPTY)
        segment = segment or f"part{len(known['segments'])}"
        if segment in known["segments"]:
            return
        docs = numbered(new.select("url", "text"), ["url", "text"], "doc_id", known["last_id"] + 1).select("doc_id", "url", "text")
        cls.of(docs, lexer)._add(path, known, segment, old.terms if old else None)

    @classmethod
    def compact(cls, spark: SparkSession, path: str, to: str, lexer: text.Lexer = "eng") -> None:
        """Writes the index of ``path``, with the segments of all its appends merged, to ``to``."""
        cls.open(spark, path, lexer).write(to)


def numbered(rows: DataFrame, by: list[str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with ``name``: numbers from ``first`` without gaps in the order of ``by``.

    Rows are ranged, numbered inside their range and written once, so that a lost executor cannot
    change them; only the ranges' counts reach the driver.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = ranged.withColumn("part_", F.spark_partition_id()).withColumn("n_", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    storage.shared_folder(rows.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    start, starts = first, []
    for r in ranged.groupBy("part_").count().orderBy("part_").collect():
        starts.append((r.part_, start))
        start += r["count"]
    offset = rows.sparkSession.createDataFrame(starts, "part_ int, start_ bigint")
    return ranged.join(F.broadcast(offset), "part_").select(*rows.columns, (F.col("start_") + F.col("n_")).cast("bigint").alias(name))


def with_ids(rows: DataFrame, first: int = 1) -> DataFrame:
    """(doc_id, url, text) with dense doc_ids in order of url, then text."""
    return numbered(rows.select("url", "text"), ["url", "text"], "doc_id", first).select("doc_id", "url", "text")


class Engine:
    def __init__(self, idx: Index) -> None:
        self.index = idx
        self.doc_n, self.avg_len = idx.sizes
        self.warm_terms: frozenset[str] = frozenset()
        self.warm_rows: DataFrame | None = None

    @property
    def term_n(self) -> int:
        return self.index.term_n

    # -- postings

    def warm(self, terms: list[str]) -> None:
        """Keeps the postings of terms in the executors' memory; queries of these terms alone
        read them there. No terms: lets them go."""
        if self.warm_rows is not None:
            self.warm_rows.unpersist()
        self.warm_terms, self.warm_rows = frozenset(terms), None
        if terms:
            self.warm_rows = self.index.postings.filter(F.col("term").isin(sorted(terms))).persist()

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, tf, pos, doc_len) of the terms."""
        rows = self.warm_rows if self.warm_rows is not None and self.warm_terms.issuperset(terms) else self.index.postings
        return rows.filter(F.col("term").isin(terms))

    def probe(self, path: str, cls: str = "token") -> DataFrame:
        """Posting dump of a formula path: (doc_id, exp_id, n_lr, path_id, symb, fr_hash)."""
        rows = self.index.math_prefix.filter((F.col("cls") == cls) & (F.col("prefix") == path) & (F.col("suffix") == ""))
        return rows.select("doc_id", "exp_id", "n_lr", "path_id", "symb", "fr_hash")

    def term_ids(self, terms: list[str]) -> DataFrame:
        """(term, term_id) of the terms that the dictionary has."""
        return self.index.terms.filter(F.col("term").isin(terms))

    def terms_of(self, ids: list[int]) -> DataFrame:
        """(term, term_id) of the dictionary's ids."""
        return self.index.terms.filter(F.col("term_id").isin(ids))

    # -- keywords

    def keywords(self, words: list[Keyword]) -> list[tuple[Keyword, int]]:
        """Keywords with df, sorted and without repeats; unknown terms have df 0."""
        terms = sorted({w.text for w in words if w.kind == "term"})
        found = {r.term: r.df for r in index.term_df(self.postings(terms)).collect()} if terms else {}
        ids = {t: i for i, t in enumerate(sorted(found), 1)}
        rows = [(w, found.get(w.text, 0) if w.kind == "term" else 0, ids.get(w.text, 0) if w.kind == "term" else 0) for w in words]
        return [(w, df) for w, df, _ in unique(by_df(rows))]

    def term_rows(self, words: list[tuple[Keyword, int]]) -> DataFrame:
        """(list_id, doc_id, tf, pos, bm25) of the postings of the term keywords."""
        rows = [(f"{k:03d}", w.text, df) for k, (w, df) in enumerate(words) if w.kind == "term"]
        kw = self.index.spark.createDataFrame(rows, "list_id string, term string, df bigint")
        hit = self.postings([r[1] for r in rows]).join(F.broadcast(kw), "term")
        idf = index.idf(F.lit(self.doc_n), F.col("df"))
        return hit.select("list_id", "doc_id", "tf", "pos", score.bm25(F.col("tf"), idf, F.col("doc_len"), F.lit(self.avg_len)).alias("bm25"))

    # -- searches

    def math_search(self, formula: str) -> DataFrame:
        """(doc_id, exp_id, suffix, level, score): one row for each match, unsorted."""
        return score.expression_scores(self.index.math_prefix, formula)

    def term_search(self, terms: list[str], op: str = "or") -> DataFrame:
        """(doc_id, score): bm25 and proximity of documents with any, or all, of the terms."""
        words = self.keywords([Keyword("term", t.lower()) for t in terms])
        if op not in merge.OPS:
            raise ValueError(f"no such merge: {op}")
        lists = F.collect_list(F.struct("list_id", "pos"))
        rows = self.term_rows(words).groupBy("doc_id").agg(F.sum("bm25").alias("bm25"), lists.alias("lists"))
        rows = rows.filter(F.size("lists") == len(words)) if op == "and" else rows
        dist = score.nearest(score.merged(F.col("lists")))
        return rank.top_k(rows.select("doc_id", score.kept(F.col("bm25") + score.proximity(dist)).alias("score")))

    def matches(self, words: list[Keyword]) -> DataFrame:
        """(doc_id, list_id, pos, bm25, math) of all keywords' lists."""
        sorted_words = self.keywords(words)
        parts = []
        if any(w.kind == "term" for w, _ in sorted_words):
            parts.append(self.term_rows(sorted_words).select("doc_id", "list_id", "pos", "bm25", F.lit(None).cast("bigint").alias("math")))
        for k, (w, _) in enumerate(sorted_words):
            if w.kind == "tex":
                try:
                    lists = score.math_lists(self.math_search(w.text))
                except ValueError:  # a keyword that isn't a formula matches nothing
                    continue
                # Q24: lists of one keyword by level, then suffix
                place = F.concat(F.lit(f"{k:03d}/"), F.format_string("%03d/", F.col("level")), F.col("suffix"))
                parts.append(lists.select("doc_id", place.alias("list_id"), "pos", F.lit(None).cast("double").alias("bm25"), F.col("score").alias("math")))
        if not parts:
            return self.index.spark.createDataFrame([], "doc_id bigint, list_id string, pos array<int>, bm25 double, math bigint")
        return reduce(DataFrame.unionByName, parts)

    def scores(self, words: list[Keyword]) -> DataFrame:
        """(doc_id, score, lists) of every document that a keyword finds; one shuffle by document.
        ``lists``: (list_id, pos) of its keywords."""
        rows = self.matches(words).groupBy("doc_id").agg(
            F.coalesce(F.sum("bm25"), F.lit(0.0)).alias("bm25"), F.coalesce(F.max("math"), F.lit(0)).alias("math"), F.sum(F.when(F.col("bm25") != 0, 1).otherwise(0)).alias("terms"),
            F.collect_list(F.struct("list_id", "pos")).alias("lists"),
        )
        dimension = F.col("terms") + (F.col("math") > 0).cast("int")
        dist = score.nearest(score.merged(F.col("lists")))
        total = score.document_score(score.proximity(dist), F.col("math"), F.col("bm25"), dimension)
        return rows.select("doc_id", score.kept(total).alias("score"), "lists")

    def search(self, words: list[Keyword], k: int = rank.TOP) -> DataFrame:
        """(doc_id, score, occurs) of the ``k`` best documents."""
        best = rank.top_k(self.scores(words), k)
        return best.select("doc_id", "score", score.first_places(score.merged(F.col("lists"))).alias("occurs"))

    # -- pages and the JSON interface

    def page(self, hits: list, page: int, opened: str = "<em>", closed: str = "</em>") -> list[dict]:
        """The hits of a page with title, url and snippet; texts are fetched for them alone."""
        a, b, _ = rank.page_window(len(hits), page)
        own = hits[a:b]
        if not own:
            return []
        rows = {r.doc_id: r for r in self.index.docs.filter(F.col("doc_id").isin([h.doc_id for h in own])).collect()}
        out = []
        for h in own:
            if h.doc_id in rows:  # Q21
                doc = rows[h.doc_id]
                out.append({"docid": h.doc_id, "score": f"{h.score:.3f}", "title": snippets.title(doc.text), "url": doc.url, "snippet": snippets.highlighted(doc.text, list(h.occurs or []), opened, closed, self.index.lexer)})
        return out

    def request(self, body: str) -> str:
        """The JSON response to a JSON request."""
        code, page, words = parse_request(body, self.index.lexer)
        if code == 0:
            hits = self.search(words).collect()
            pages = rank.page_count(len(hits))
            code = 3 if page == 1 and not pages else 4 if page > pages else 0
            if code == 0:
                return json.dumps({"ret_code": 0, "ret_str": MESSAGES[0], "tot_pages": pages, "hits": self.page(hits, page)})
        return json.dumps({"ret_code": code, "ret_str": MESSAGES[code], "tot_pages": 0, "hits": []})

    def lookup(self, doc_id: int) -> DataFrame:
        return self.index.docs.filter(F.col("doc_id") == doc_id)

    def by_url(self, formula: str, url: str = "*") -> DataFrame:
        """Which of a formula's query paths documents with a url hold: (element, prefix, cls,
        doc_id, exp_id, suffix, url)."""
        query = score.MathQuery(formula)
        table = self.index.spark.createDataFrame(query.rows(), "element int, cls string, prefix string")
        docs = self.index.docs.select("doc_id", "url")
        docs = docs if url == "*" else docs.filter(F.col("url") == url)
        return self.index.math_prefix.join(F.broadcast(table), ["cls", "prefix"]).join(docs, "doc_id").select("element", "prefix", "cls", "doc_id", "exp_id", "suffix", "url").distinct()

    def terms_with_df(self, over: int = 0) -> DataFrame:
        """Index dump: terms in more than ``over`` documents."""
        return index.term_df(self.index.postings).filter(F.col("df") > over)

    def dump(self, term: str) -> DataFrame:
        """Index dump: (doc_id, url, doc_len, tf, pos) of a term's postings."""
        return self.postings([term]).join(self.index.docs.select("doc_id", "url"), "doc_id").select("doc_id", "url", "doc_len", "tf", "pos")

    def summary(self) -> dict[str, int]:
        """Index dump: its sums."""
        return {"doc_n": self.doc_n, "avg_doc_len": self.avg_len, "term_n": self.term_n}


__all__ = ["Engine", "Index", "Keyword", "checked", "numbered", "with_ids"]
