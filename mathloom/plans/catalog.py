"""The driver's queries of the search engine, and SQL for DuckDB with the same results."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import threading
import urllib.request
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import codec, register, snippets
from mathloom.functions.segment import Segmenter
from mathloom.operators import index, merge, rank, score, text
from mathloom.plans import storage
from mathloom.plans.engine import Engine, Index
from mathloom.plans.query import Keyword, by_df, classified, parse_request, unique
from mathloom.plans.server import server
from mathloom.sources import corpus, delimiters, html
from mathloom.streaming.ingest import append_batch, follow

#: Keywords of the term queries; the last one is in no document.
TERMS = ("that", "the", "with", "zzznope")
Query = Callable[[SparkSession, str], DataFrame]

CASES: tuple[tuple[str, str, tuple[tuple[str, int], ...]], ...] = (
    ("alpha", r"a + \frac 1 a = a", ((r"a + \frac 1 a = a", 400), (r"b + \frac 1 b = b", 397), (r"a + \frac 1 b = a", 300))),
    ("inequality", "2^k > 4k", (("4k < 2^k", 400), ("2^n > 4n", 398), ("2^m > 8m", 397))),
    ("nil", "- b", (("a - b", 50), ("a - b - b", 33))),
    ("order", r"\frac a 3", ((r"\frac{a}{3}", 200), (r"\frac{b}3", 199), (r"\frac 3 a", 0))),
    ("integral", r"\oint \frac{dz}{1-z^2}", ((r"\oint \frac{dz}{1-z^2}", 600), (r"\oint \frac{dx}{1-x^2}", 598))),
    ("symbolic", r"\beta x", ((r"\beta x", 200), ("bx", 199), ("yz", 198))),
    ("powers", "x^5+y^6=z^7", (("x^5+y^6=z^7", 600), ("x^2+y^2=z^2", 597), ("a^3+b^3=c^3", 594))),
    ("difference", "y^2-x^3", (("x^2 - y^3", 398), ("X^4 - Y^2", 396))),
    ("wildcard", r"f(x) = \qvar{x} + \frac \qvar{x} 2", ((r"f(a) = a^2 + \frac {a^2} 2", 132), (r"f(a) = b^2 + \frac {a^2} 2", 99))),
)
FORMULAE = (("a+b", 0, 2), (r"\frac12", 0, 2), ("(a", 1, 0), ("", 0, 1), (r"\sqrt[3]{x}", 0, 2), ("x" * 64, 1, 0), (r"\text{if } x", 0, 1), ("}", 1, 0))
REQUESTS = (
    ('{"page": 1, "kw": [{"type": "tex", "str": "f(x)"}, {"type": "term", "str": "such that"}]}', 0),
    ('{"page": 1, "kw": [', 2),
    ('{"kw": [{"type": "term", "str": "x"}]}', 2),
    ('{"page": 1}', 2),
    ('{"page": 1, "kw": [{"kind": "term", "str": "x"}]}', 2),
    ('{"page": 1, "kw": [{"str": "x"}]}', 2),
    ('{"page": 1, "kw": [{"type": "word", "str": "x"}]}', 2),
    ('{"page": 1, "kw": [{"type": "term", "str": 5}]}', 2),
    ('{"page": 0, "kw": []}', 2),
    ('{"page": 1.5, "kw": []}', 2),
    ('{"page": 1, "kw": []}', 1),
    ('{"page": 1, "kw": [%s]}' % ", ".join(['{"type": "tex", "str": "x"}'] * 5), 6),
    ('{"page": 1, "kw": [{"type": "term", "str": "%s"}]}' % " ".join("abcdefghijklmnopqrstu"), 7),
)
SEARCH_LINES = ("$x^2 + ?$, such that", "prime, $a,b$ ,, gcd", "  ")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return text.tokens(_documents(s, d).select("doc_id", "text"))


def _postings(s: SparkSession, d: str) -> DataFrame:
    return index.postings(_documents(s, d).select("doc_id", "text"))


def _written(s: SparkSession, d: str) -> str:
    """Where the index of the documents is, in the folder of this application's checkpoints;
    searches share it, as they would in use."""
    path = f"{storage.shared_folder(s)}/search-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    if not storage.exists(s, f"{path}/index.json"):
        Index.of(_documents(s, d).select("doc_id", F.lit("").alias("url"), "text")).write(path)
    return path


def _engine(s: SparkSession, d: str) -> Engine:
    return Engine(Index.open(s, _written(s, d)))


def _scratch(s: SparkSession) -> str:
    return f"{storage.shared_folder(s)}/scratch-{uuid.uuid4().hex}"


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _rounded(name: str) -> Column:
    return (F.round(F.col(name), 6) + 0.0).alias(name)


def _matched(s: SparkSession, d: str, terms: tuple[str, ...]) -> DataFrame:
    """(k, doc_id, pos) of the terms' postings."""
    kw = s.createDataFrame(list(enumerate(terms)), "k int, term string")
    return _tokens(s, d).filter(F.col("term").isin(list(terms))).join(F.broadcast(kw), "term").select("k", "doc_id", "pos")


def tokenize_count(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.size(text.token_array(F.col("text"))).cast("bigint").alias("n_tokens"))


def token_positions(s: SparkSession, d: str) -> DataFrame:
    return _tokens(s, d).select("doc_id", *_long("pos"), "term")


def token_offsets(s: SparkSession, d: str) -> DataFrame:
    return text.token_offsets(_documents(s, d)).select("doc_id", *_long("pos"), "token", "offset")


def mixed_lexer(s: SparkSession, d: str) -> DataFrame:
    return text.tokens(_documents(s, d), lexer="mix").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("pos").cast("bigint").alias("last_pos"))


def postings_tf(s: SparkSession, d: str) -> DataFrame:
    return _postings(s, d).select("term", "doc_id", *_long("tf"), F.element_at("pos", 1).cast("bigint").alias("first_pos"))


def term_df(s: SparkSession, d: str) -> DataFrame:
    return index.term_df(_postings(s, d))


def doc_len(s: SparkSession, d: str) -> DataFrame:
    return index.with_lengths(_documents(s, d).select("doc_id"), _tokens(s, d)).select("doc_id", "doc_len")


def collection_stats(s: SparkSession, d: str) -> DataFrame:
    toks = _tokens(s, d)
    return index.stats(index.with_lengths(_documents(s, d).select("doc_id"), toks), toks.select("term"))


def term_idf(s: SparkSession, d: str) -> DataFrame:
    n = _documents(s, d).count()
    return term_df(s, d).select("term", index.idf(F.lit(n), F.col("df")).alias("idf")).select("term", _rounded("idf"))


def or_merge(s: SparkSession, d: str) -> DataFrame:
    return merge.merge(_matched(s, d, TERMS[:3]), "or", 3)


def and_merge(s: SparkSession, d: str) -> DataFrame:
    return merge.merge(_matched(s, d, TERMS[:3]), "and", 3)


def empty_list_merge(s: SparkSession, d: str) -> DataFrame:
    terms = (TERMS[0], TERMS[3])
    parts = [merge.merge(_matched(s, d, terms), op, 2).select(F.lit(op).alias("op"), "doc_id") for op in merge.OPS]
    return reduce(DataFrame.unionByName, parts)


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).term_search(list(TERMS)).select("doc_id", _rounded("score"))


def term_and_topk(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).term_search(list(TERMS[:3]), "and").select("doc_id", _rounded("score"))


def min_proximity(s: SparkSession, d: str) -> DataFrame:
    return score.min_distance(_matched(s, d, TERMS).withColumnRenamed("k", "list_id")).select("doc_id", *_long("dist"))


def prox_score(s: SparkSession, d: str) -> DataFrame:
    return min_proximity(s, d).select("doc_id", score.proximity(F.col("dist")).alias("prox")).select("doc_id", _rounded("prox"))


def mixed_score_term_only(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).search([Keyword("term", t) for t in TERMS]).select("doc_id", _rounded("score"))


def occurrences8(s: SparkSession, d: str) -> DataFrame:
    return score.occurrences(_matched(s, d, TERMS)).select("doc_id", F.array_join(F.col("occurs").cast("array<string>"), " ").alias("occurs"))


def page_window(s: SparkSession, d: str) -> DataFrame:
    return rank.with_pages(_engine(s, d).term_search(list(TERMS))).select("doc_id", "rank", "page")


def title_extract(s: SparkSession, d: str) -> DataFrame:
    talks = s.read.parquet(f"{d}/conversations.parquet")
    whole = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit("\n\n"), F.col("text"))).otherwise(F.translate("text", "\n", " "))
    return talks.select("conv_id", "turn", text.title(whole).alias("title"), F.length(text.one_line(whole)).cast("bigint").alias("n"))


def query_dedupe(s: SparkSession, d: str) -> DataFrame:
    given = [("term", "dog", 90800, 1234), ("term", "cat", 1300, 1235), ("tex", "f(x)", 0, 0), ("term", "the", 9999999, 1234), ("tex", "2x^3 + x", 0, 0), ("term", "hello", 0, 0), ("term", "world", 0, 0)]
    kept = unique(by_df([(Keyword(k, t), df, i) for k, t, df, i in given]))
    return s.createDataFrame([(n, w.kind, w.text) for n, (w, *_) in enumerate(kept)], "place bigint, kind string, word string")


def df_threshold_dump(s: SparkSession, d: str) -> DataFrame:
    return term_df(s, d).filter(F.col("df") > 10)


def html_text(s: SparkSession, d: str) -> DataFrame:
    pages = s.read.parquet(f"{d}/pages.parquet").withColumn("text", html.html_text(F.col("html")))
    return pages.select("page_id", text.title(F.col("text")).alias("title"), "text")


def _part(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet")


def delimiter_normalise(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("see \\(x_"), F.col("p_size").cast("string"), F.lit("\\) and \\[y\n="), F.col("p_partkey").cast("string"), F.lit("\\] \\minus{}1"))
    done = delimiters.canonical_macros(delimiters.normalise_inline(delimiters.normalise_display(raw)))
    return _part(s, d).select(*_long("p_partkey"), done.alias("text"))


def dollar_normalise(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("cost \\$"), F.col("p_size").cast("string"), F.lit(" $x_"), F.col("p_partkey").cast("string"), F.lit("$ or $$y$$ end"))
    return _part(s, d).select(*_long("p_partkey"), delimiters.normalise_dollars(raw).alias("text"))


def for_delta_roundtrip(s: SparkSession, d: str) -> DataFrame:
    rows = _postings(s, d).withColumn("diff", codec.deltas(F.col("pos").cast("array<bigint>")))
    rows = rows.withColumn("back", codec.restored(F.col("diff")))
    return rows.select("term", "doc_id", F.array_max("diff").alias("largest"), (F.col("back") == F.col("pos").cast("array<bigint>")).alias("same"))


def for_width(s: SparkSession, d: str) -> DataFrame:
    return _postings(s, d).select("term", "doc_id", codec.width_column(F.array_max("pos").cast("bigint")).cast("bigint").alias("width"))


def _formula_engine(docs: DataFrame) -> Engine:
    """Of (doc_id, text)."""
    return Engine(Index.of(docs.select("doc_id", F.lit("").alias("url"), "text")))


def _tagged(*parts: Column) -> Column:
    return F.concat(F.lit("[imath]"), *parts, F.lit("[/imath]"))


def _grid_formula() -> Column:
    up = lambda c: (2 + F.col(c) % 7).cast("string")
    return _tagged(F.lit("x^{"), up("p_size"), F.lit("}+y^{"), up("p_partkey"), F.lit("}=z"))


def math_symbol_grid(s: SparkSession, d: str) -> DataFrame:
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), _grid_formula().alias("text"))
    return _formula_engine(docs).math_search("x^2+y^3=z").groupBy("doc_id").agg(F.max("score").alias("score"))


def math_rank_cases(s: SparkSession, d: str) -> DataFrame:
    out = []
    for name, query, docs in CASES:
        rows = s.createDataFrame([(i, f"[imath]{t}[/imath]") for i, (t, _) in enumerate(docs, 1)], "doc_id bigint, text string")
        hits = _formula_engine(rows).search([Keyword("tex", query)])
        total = F.round(F.col("score"), 3)
        out.append(rank.with_pages(hits).select(F.lit(name).alias("name"), "rank", "doc_id", total.alias("score")))
    return reduce(DataFrame.unionByName, out)


def math_subexpr_level(s: SparkSession, d: str) -> DataFrame:
    deep = (F.col("p_partkey") % 8).cast("int")
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), _tagged(F.repeat(F.lit("\\sqrt{"), deep), F.lit("a+b"), F.repeat(F.lit("}"), deep)).alias("text"))
    return _formula_engine(docs).math_search("a+b").select("doc_id", *_long("level"), "score")


def math_paths(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(1, 0, "a+k(b+c)"), (2, 0, r"\sqrt{pq + m}")], "doc_id bigint, exp_id int, tex string")
    return index.math_paths(rows).select("doc_id", "cls", "path", *_long("path_id", "n_lr"))


def mixed_query(s: SparkSession, d: str) -> DataFrame:
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.concat(F.col("p_name"), F.lit(" "), _grid_formula()).alias("text"))
    words = [Keyword("tex", "x^2+y^3=z"), Keyword("term", "cold")]
    return _formula_engine(docs).scores(words).select("doc_id", _rounded("score"))


def snippet(s: SparkSession, d: str) -> DataFrame:
    engine = _engine(s, d)
    hits = engine.search([Keyword("term", t) for t in TERMS[:2]])
    rows = engine.index.docs.select("doc_id", "text").join(F.broadcast(hits), "doc_id")  # 155 hits
    return rows.select("doc_id", register.snippet_of(F.col("text"), F.col("occurs")).alias("snippet"))


def parse_stats(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FORMULAE)], "id bigint, tex string")
    return rows.select("id", index.parsed(F.col("tex")).alias("p")).select("id", F.col("p.code").cast("bigint").alias("code"), F.col("p.n_lr").cast("bigint").alias("n_lr"))


def parse_counts(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FORMULAE)], "doc_id bigint, tex string")
    return index.parse_counts(rows)


def json_api_codes(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, parse_request(body)[0]) for i, (body, _) in enumerate(REQUESTS)], "id bigint, code bigint")


def search_lines(s: SparkSession, d: str) -> DataFrame:
    rows = [(i, k, w.kind, w.text) for i, line in enumerate(SEARCH_LINES) for k, w in enumerate(classified(line))]
    return s.createDataFrame(rows, "line bigint, place bigint, kind string, word string")


def _halves(s: SparkSession, d: str) -> str:
    """An index of the even documents to which the odd ones are appended, twice by one name, and
    then merged."""
    at = _scratch(s)
    docs = _documents(s, d).select("doc_id", F.concat(F.lit("u"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("url"), "text")
    for k, name in ((0, "even"), (1, "odd"), (1, "odd")):
        Index.append(f"{at}/parts", docs.filter(F.col("doc_id") % 2 == k), segment=name)
    Index.compact(s, f"{at}/parts", f"{at}/whole")
    return f"{at}/whole"


def incremental_append(s: SparkSession, d: str) -> DataFrame:
    return Index.open(s, _halves(s, d)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def append_ids(s: SparkSession, d: str) -> DataFrame:
    return Index.open(s, _halves(s, d)).docs.select("doc_id", "url", "doc_len")


def append_stats(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([tuple(Engine(Index.open(s, _halves(s, d))).summary().values())], "doc_n bigint, avg_doc_len bigint, term_n bigint")


def term_dictionary(s: SparkSession, d: str) -> DataFrame:
    engine = _engine(s, d)
    again = engine.terms_of([1, 2, 3]).withColumnRenamed("term", "reverse")
    return engine.index.terms.join(F.broadcast(again), "term_id", "left").select("term", "term_id", "reverse")


def posting_dump(s: SparkSession, d: str) -> DataFrame:
    engine = _engine(s, d)
    engine.warm(["the"])
    rows = engine.dump("the").select("doc_id", "doc_len", *_long("tf"), F.array_join(F.col("pos").cast("array<string>"), " ").alias("pos"))
    return rows


def path_probe(s: SparkSession, d: str) -> DataFrame:
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), _tagged(F.lit("a+"), F.repeat(F.lit("b"), 1), F.lit("")).alias("text"))
    return _formula_engine(docs).probe("VAR/ADD").select("doc_id", *_long("path_id", "n_lr"))


def _urls(s: SparkSession, d: str) -> Engine:
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.concat(F.lit("http://x/"), F.col("p_size").cast("string")).alias("url"), _grid_formula().alias("text"))
    return Engine(Index.of(docs))


def url_lookup(s: SparkSession, d: str) -> DataFrame:
    return _urls(s, d).by_url("x^2+y^3=z", "http://x/7").groupBy("doc_id", "url").agg(F.count_distinct("element").alias("n_elements"))


def doc_lookup(s: SparkSession, d: str) -> DataFrame:
    return _urls(s, d).lookup(5).select("doc_id", "url", "text")


def json_response(s: SparkSession, d: str) -> DataFrame:
    """The second page of a request, by the HTTP daemon."""
    daemon = server(_engine(s, d), port=0)
    threading.Thread(target=daemon.serve_forever, daemon=True).start()
    body = json.dumps({"page": 2, "kw": [{"type": "term", "str": " ".join(TERMS)}]}).encode()
    try:
        got = json.loads(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{daemon.server_port}/search", body)).read())
    finally:
        daemon.shutdown()
    return s.createDataFrame([(k, got["ret_code"], got["tot_pages"], h["docid"], h["score"], h["title"]) for k, h in enumerate(got["hits"], 11)], "rank bigint, code bigint, pages bigint, doc_id bigint, score string, title string")


def console_page(s: SparkSession, d: str) -> DataFrame:
    from mathloom.__main__ import main

    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        main([_written(s, d), *[x for t in TERMS for x in ("-t", t)], "-p", "2"])
    found = re.findall(r"(?m)^(\d+)  (-?\d+\.\d{3})  ", said.getvalue())
    return s.createDataFrame([(k, int(i), v) for k, (i, v) in enumerate(found, 11)], "rank bigint, doc_id bigint, score string")


def _nations(s: SparkSession, d: str) -> DataFrame:
    name = F.col("n_name")
    url = F.when(F.col("n_nationkey") % 5 == 1, "").otherwise(F.concat(F.lit("n/"), name))
    return s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", url.alias("url"), F.concat(F.lit("The nation of "), name).alias("text"))


def corpus_files(s: SparkSession, d: str) -> DataFrame:
    """JSON files in folders, some without a url, written, counted and read; and text files."""
    at = _scratch(s)
    rows = _nations(s, d)
    rows.write.partitionBy("n_nationkey").json(f"{at}/json")
    rows.select("text").write.text(f"{at}/text")
    corpus.write_json(corpus.json_corpus(s, f"{at}/json"), f"{at}/again")
    lines = corpus.text_corpus(s, f"{at}/text").select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    parts = (
        s.read.schema("url string, text string").json(f"{at}/again").select(F.lit("document").alias("kind"), "url", "text"),
        lines.select(F.lit("line").alias("kind"), F.lit(None).cast("string").alias("url"), "text"),
        corpus.json_rejects(s, f"{at}/json").select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("reason").alias("text")),
        s.createDataFrame([("files", None, str(corpus.count_files(s, f"{at}/json")))], "kind string, url string, text string"),
    )
    return reduce(DataFrame.unionByName, parts)


def stream_index(s: SparkSession, d: str) -> DataFrame:
    """Files that a stream indexes in small batches; the last batch sent again adds nothing."""
    at = _scratch(s)
    _nations(s, d).write.partitionBy("n_nationkey").json(f"{at}/json")
    follow(s, f"{at}/json", f"{at}/index", f"{at}/state", files_per_batch=10).awaitTermination()
    append_batch(f"{at}/index", _nations(s, d).select("url", "text"), segment="batch0")
    return Index.open(s, f"{at}/index").postings.groupBy("term").agg(F.count("*").alias("df"))


def for_pack(s: SparkSession, d: str) -> DataFrame:
    rows = _postings(s, d).withColumn("blob", codec.packed(F.col("pos")))
    same = codec.unpacked(F.col("blob"), F.size("pos")) == F.col("pos").cast("array<bigint>")
    return rows.select("term", "doc_id", F.lower(F.hex("blob")).alias("packed"), same.alias("same"))


def codec_roundtrip(s: SparkSession, d: str) -> DataFrame:
    names = sorted(codec.CODECS)
    rows = _postings(s, d).select(codec.round_trips(F.col("pos")).alias("same"))
    told = rows.agg(F.count("*").alias("n_lists"), *[F.coalesce(F.every(F.get("same", F.lit(k))), F.lit(True)).alias(f"same{k}") for k in range(len(names))])
    each = F.array(*[F.struct(F.lit(name).alias("codec"), F.col(f"same{k}").alias("same")) for k, name in enumerate(names)])
    return told.select("n_lists", F.explode(each).alias("x")).select("x.codec", "n_lists", "x.same")


def dictionary_lexer(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("中文"), F.repeat(F.lit("字典"), (F.col("p_size") % 3).cast("int")), F.lit("啊 Bolt"))
    docs = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), raw.alias("text"))
    return text.tokens(docs, lexer=Segmenter(["中文", "字典", "典"])).select("doc_id", *_long("pos"), "term")


def sql_functions(s: SparkSession, d: str) -> DataFrame:
    register.register(s)
    rows = _part(s, d).select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.concat(F.lit("a+b_"), F.col("p_size").cast("string")).alias("tex"))
    return rows.select("doc_id", F.expr("cast(tex_parse(tex).code as bigint)").alias("code"), F.expr("snippet(concat('x y ', doc_id), array(1))").alias("snippet"), F.expr("cast(mnc_score(array(1), array(struct(1, 1, array(1)))) as bigint)").alias("marks"))


SNIPPETS = (
    (("a" * 10 + "KEY" + "b" * 5 + "WORD" + "c" * 10, ((10, 13), (18, 22)), 8), "a" * 8 + "<KEY>" + "b" * 5 + "<WORD>" + "c" * 7 + " ... "),
    (("xxKEYabé", ((2, 5),), 4), "xx<KEY>ab ... "),
    (("éKEY\nz\r", ((2, 5),), 1), "<KEY> ... "),
)


def snippet_fixtures(s: SparkSession, d: str) -> DataFrame:
    made = [snippets.snippet(t, list(marks), "<", ">", pad) for (t, marks, pad), _ in SNIPPETS]
    made += [snippets.highlighted("one [imath]x+1[/imath] two", [1, 2], "<", ">"), snippets.spaced("a<b")]
    return s.createDataFrame(list(enumerate(made)), "id bigint, snippet string")


def lenient_lines(s: SparkSession, d: str) -> DataFrame:
    rows = [(i, k, w.kind, w.text) for i, line in enumerate(("a+b, word", "f(x), $y$", "plain")) for k, w in enumerate(classified(line, lenient=True))]
    return s.createDataFrame(rows, "line bigint, place bigint, kind string, word string")


def merge_ops(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id bigint, k int")

    def told(op: str) -> int:
        try:
            return merge.merge(rows, op, 2).count()
        except ValueError:
            return -1

    return s.createDataFrame([(op, told(op)) for op in ("or", "and", "xor")], "op string, n bigint")


def proximity_fixtures(s: SparkSession, d: str) -> DataFrame:
    lists = {1: ((5, 8, 10, 19), (1, 4, 9), (2, 3, 6, 7, 11, 15)), 2: ((8, 9, 11, 12, 13), (1, 2, 3, 4), (16, 17)), 3: ((500, 512),)}
    rows = s.createDataFrame([(k, i, p) for k, v in lists.items() for i, own in enumerate(v) for p in own], "doc_id bigint, list_id int, pos int")
    return score.min_distance(rows).select("doc_id", *_long("dist"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tokenize_count, token_positions, token_offsets, mixed_lexer, postings_tf, term_df, doc_len, collection_stats, term_idf, or_merge, and_merge, empty_list_merge, bm25_topk, term_and_topk, min_proximity,
        prox_score, mixed_score_term_only, occurrences8, page_window, title_extract, query_dedupe, df_threshold_dump, url_lookup, html_text, delimiter_normalise, dollar_normalise, for_delta_roundtrip, for_width,
        math_symbol_grid, math_rank_cases, math_subexpr_level, math_paths, mixed_query, snippet, parse_stats, parse_counts, json_api_codes, search_lines, incremental_append, proximity_fixtures,
        append_ids, append_stats, term_dictionary, posting_dump, path_probe, doc_lookup, json_response, console_page, corpus_files, stream_index, for_pack, codec_roundtrip, dictionary_lexer, sql_functions,
        snippet_fixtures, lenient_lines, merge_ops,
    )
}


# ---------------------------------------------------------------- SQL

TOK = """tok as (select doc_id, lower(unnest(l)) as term, cast(generate_subscripts(l, 1) - 1 as bigint) as pos
    from (select doc_id, regexp_extract_all(text, '[a-zA-Z]+') as l from documents))"""
POST = TOK + ", post as (select term, doc_id, least(count(*), 2048) as tf, list_slice(list_sort(list(pos)), 1, 2048) as pos from tok group by all)"


def _kw(terms: tuple[str, ...]) -> str:
    return "kw(k, term) as (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms)) + ")"


def _hits(terms: tuple[str, ...]) -> str:
    return f"""{TOK}, {_kw(terms)}, hit as (select k, doc_id, pos from tok join kw using (term)),
near as (select doc_id, min(case when p <> pos and l <> k then pos - p end) as dist from
    (select doc_id, pos, k, lag(pos) over w as p, lag(k) over w as l from hit window w as (partition by doc_id order by pos, k)) group by doc_id),
len as (select doc_id, cast(count(t.term) as bigint) as doc_len from documents d left join tok t using (doc_id) group by doc_id),
coll as (select cast(count(*) as bigint) as n, cast(floor(sum(doc_len) / count(*)) as bigint) as avg_len from len),
tf as (select k, doc_id, least(count(*), 2048) as tf from hit group by all),
df as (select k, count(*) as df from tf group by k),
bm as (select k, doc_id, ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 1.5 / avg_len * doc_len)) as bm25
    from tf join df using (k) join len using (doc_id), coll),
sums as (select doc_id, sum(bm25) as bm25, sum(case when bm25 <> 0 then 1 else 0 end) as terms, count(*) as lists from bm group by doc_id)"""


PROX = "ln(0.3 + coalesce(exp(-dist), 0))"
TERM_TOP = f"top as (select doc_id, round(bm25 + {PROX}, 9) as score from sums join near using (doc_id) order by score desc, doc_id limit 155)"
MIXED_TOP = f"select doc_id, round({PROX} + 0.5 * (1 + bm25) + 10000 * terms, 9) as score from sums join near using (doc_id) order by score desc, doc_id limit 155"
TITLE = "case when instr(text, chr(10) || chr(10)) > 0 then substr(text, 1, instr(text, chr(10) || chr(10)) - 1) else 'No title available.' end"
WIDTH = "case when {0} < 4 then 2 when {0} < 16 then 4 when {0} < 32 then 5 when {0} < 64 then 6 when {0} < 256 then 8 when {0} < 1024 then 10 when {0} < 65536 then 16 else 32 end"
# A page's text, of its HTML without scripts, styles and comments.
UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&copy;', chr(169)), '&amp;', '&')"
UNTAGGED = "regexp_replace({0}, '<[^>]*>', '', 'g')"
PAGE_TITLE = UNESCAPED.format(UNTAGGED.format("regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))
PARAGRAPH = UNESCAPED.format(UNTAGGED.format("regexp_extract(x, '(?s)^[^>]*>(.*?)(?:</p>|</div>|</article>|</body>|</footer>|$)', 1)"))
PAGE_TEXT = f"""with p as (select page_id, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') as h from pages),
t as (select page_id, {PAGE_TITLE} as head, list_filter(list_transform(regexp_split_to_array(h, '<p\\b')[2:], lambda x: {PARAGRAPH}), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '') as parts from p),
w as (select page_id, head || chr(10) || chr(10) || array_to_string(list_transform(parts, lambda x: x || chr(10)), '') as text from t)
select page_id, {TITLE} as title, text from w"""
GRID = """case when i = j then case when i in (2, 3) then 499 else 498 end when i = 2 then case when j = 3 then 500 else 499 end
    when j = 2 then case when i = 3 then 500 else 499 end when j = 3 then 499 else 498 end"""
GRID_ROWS = "grid as (select cast(p_partkey as bigint) as doc_id, p_name, 2 + p_size % 7 as i, 2 + p_partkey % 7 as j from part)"


def _values(rows: list[tuple], names: str, casts: str = "") -> str:
    def lit(v: object) -> str:
        return "null" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"select {casts or '*'} from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


def _rank_values() -> list[tuple]:
    out = []
    for name, _, docs in CASES:
        hits = sorted(((s, i) for i, (_, s) in enumerate(docs, 1) if s), key=lambda x: (-x[0], x[1]))
        out += [(name, r, i, round(10000 + (1 + s) / 2 - 1.2039728043259361, 3)) for r, (s, i) in enumerate(hits, 1)]
    return out


ORACLE: dict[str, str] = {
    "tokenize_count": "select doc_id, cast(len(regexp_extract_all(text, '[a-zA-Z]+')) as bigint) as n_tokens from documents",
    "token_positions": f"with {TOK} select doc_id, pos, term from tok",
    "token_offsets": """with l as (select doc_id, text, regexp_extract_all(text, '[a-zA-Z]+') as t, regexp_split_to_array(text, '[a-zA-Z]+') as g from documents),
u as (select doc_id, unnest(t) as token, unnest(g[1:len(t)]) as gap, generate_subscripts(t, 1) - 1 as pos from l)
select doc_id, cast(pos as bigint) as pos, token, cast(sum(strlen(gap)) over w + coalesce(sum(strlen(token)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
from u window w as (partition by doc_id order by pos)""",
    "mixed_lexer": "select doc_id, n as n_tokens, n - 1 as last_pos from (select doc_id, cast(len(regexp_extract_all(text, '[a-zA-Z]+|[^\\x00-\\x7F]')) as bigint) as n from documents) where n > 0",
    "postings_tf": f"with {TOK} select term, doc_id, least(count(*), 2048) as tf, min(pos) as first_pos from tok group by all",
    "term_df": f"with {TOK} select term, count(distinct doc_id) as df from tok group by term",
    "doc_len": "select doc_id, cast(len(regexp_extract_all(text, '[a-zA-Z]+')) as bigint) as doc_len from documents",
    "collection_stats": f"with {TOK} select count(*) as doc_n, cast(floor(sum(n) / count(*)) as bigint) as avg_doc_len, (select count(distinct term) from tok) as term_n from (select len(regexp_extract_all(text, '[a-zA-Z]+')) as n from documents)",
    "term_idf": f"with {TOK}, df as (select term, count(distinct doc_id) as df from tok group by term) select term, round(ln((n - df + 0.5) / (df + 0.5)), 6) + 0.0 as idf from df, (select count(*) as n from documents)",
    "or_merge": f"with {_hits(TERMS[:3])} select doc_id, count(distinct k) as n_lists from hit group by doc_id",
    "and_merge": f"with {_hits(TERMS[:3])} select doc_id, count(distinct k) as n_lists from hit group by doc_id having n_lists = 3",
    "empty_list_merge": f"with {TOK}, {_kw((TERMS[0], TERMS[3]))} select distinct 'or' as op, doc_id from tok join kw using (term)",
    "bm25_topk": f"with {_hits(TERMS)}, {TERM_TOP} select doc_id, round(score, 6) + 0.0 as score from top",
    "term_and_topk": f"with {_hits(TERMS[:3])} select doc_id, round(score, 6) + 0.0 as score from (select doc_id, round(bm25 + {PROX}, 9) as score from sums join near using (doc_id) where lists = 3 order by score desc, doc_id limit 155)",
    "min_proximity": f"with {_hits(TERMS)} select doc_id, cast(dist as bigint) as dist from near",
    "prox_score": f"with {_hits(TERMS)} select doc_id, round({PROX}, 6) + 0.0 as prox from near",
    "mixed_score_term_only": f"with {_hits(TERMS)} select doc_id, round(score, 6) + 0.0 as score from ({MIXED_TOP})",
    "occurrences8": f"with {_hits(TERMS)} select doc_id, array_to_string(list_slice(list_sort(list_distinct(list(pos))), 1, 8), ' ') as occurs from hit group by doc_id",
    "page_window": f"with {_hits(TERMS)}, {TERM_TOP}, r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from top) select doc_id, rank, cast(ceil(rank / 10) as bigint) as page from r",
    "title_extract": """with w as (select conv_id, turn, case when turn % 2 = 0 then role || chr(10) || chr(10) || text else replace(text, chr(10), ' ') end as t from conversations)
select conv_id, turn, case when instr(t, chr(10) || chr(10)) > 0 then substr(t, 1, instr(t, chr(10) || chr(10)) - 1) else 'No title available.' end as title, cast(length(t) as bigint) as n from w""",
    "query_dedupe": _values([(0, "tex", "f(x)"), (1, "tex", "2x^3 + x"), (2, "term", "hello"), (3, "term", "world"), (4, "term", "cat"), (5, "term", "dog")], "place, kind, word", "cast(place as bigint) as place, kind, word"),
    "df_threshold_dump": f"with {TOK} select term, count(distinct doc_id) as df from tok group by term having df > 10",
    "html_text": PAGE_TEXT,
    "delimiter_normalise": "select cast(p_partkey as bigint) as p_partkey, 'see [imath]x_' || p_size || '[/imath] and [imath]y' || chr(10) || '=' || p_partkey || '[/imath] -1' as text from part",
    "dollar_normalise": "select cast(p_partkey as bigint) as p_partkey, 'cost $' || p_size || ' [imath]x_' || p_partkey || '[/imath] or [imath]y[/imath] end' as text from part",
    "for_delta_roundtrip": f"with {TOK}, d as (select term, doc_id, pos - coalesce(lag(pos) over (partition by term, doc_id order by pos), 0) as diff, row_number() over (partition by term, doc_id order by pos) as r from tok) select term, doc_id, max(diff) as largest, true as same from d where r <= 2048 group by all",
    "for_width": f"with {POST}, m as (select term, doc_id, list_max(pos) as m from post) select term, doc_id, cast(case when m < 4 then 2 when m < 16 then 4 when m < 32 then 5 when m < 64 then 6 when m < 256 then 8 when m < 1024 then 10 when m < 65536 then 16 else 32 end as bigint) as width from m",
    "math_symbol_grid": f"with {GRID_ROWS} select doc_id, cast({GRID} as bigint) as score from grid",
    "math_rank_cases": _values(_rank_values(), "name, rank, doc_id, score", "name, cast(rank as bigint) as rank, cast(doc_id as bigint) as doc_id, cast(score as double) as score"),
    "math_subexpr_level": "select cast(p_partkey as bigint) as doc_id, cast(2 * (p_partkey % 8) as bigint) as level, cast(200 // (2 * (p_partkey % 8) + 1) as bigint) as score from part",
    "math_paths": _values(
        [
            (1, "token", "VAR/ADD", 1, 4), (1, "token", "VAR/TIMES/ADD", 2, 4), (1, "gener", "ADD", 2, 4), (1, "token", "VAR/ADD/GROUP/TIMES/ADD", 3, 4), (1, "gener", "GROUP/TIMES/ADD", 3, 4),
            (1, "token", "VAR/ADD/GROUP/TIMES/ADD", 4, 4), (2, "token", "VAR/TIMES/ADD/rank1/ROOT", 1, 3), (2, "gener", "ADD/rank1/ROOT", 1, 3), (2, "gener", "rank1/ROOT", 2, 3),
            (2, "token", "VAR/TIMES/ADD/rank1/ROOT", 2, 3), (2, "token", "VAR/ADD/rank1/ROOT", 3, 3),
        ],
        "doc_id, cls, path, path_id, n_lr", "cast(doc_id as bigint) as doc_id, cls, path, cast(path_id as bigint) as path_id, cast(n_lr as bigint) as n_lr",
    ),
    "mixed_query": f"""with {GRID_ROWS}, w as (select *, list_transform(regexp_extract_all(p_name, '[a-zA-Z]+'), lambda x: lower(x)) as l from grid), t as (select *, len(l) + 1 as doc_len,
    len(list_filter(l, lambda x: x = 'cold')) as tf, {GRID} as math from w),
c as (select count(*) as n, floor(sum(doc_len) / count(*)) as avg_len, sum(case when tf > 0 then 1 else 0 end) as df from t),
s as (select *, case when tf > 0 then ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 1.5 / avg_len * doc_len)) else 0 end as bm25,
    case when tf > 0 then len(l) - (len(l) - list_position(list_reverse(l), 'cold')) end as dist from t, c)
select doc_id, round({PROX} + (1 + math) / 2.0 * (1 + bm25) + 10000 * (1 + case when bm25 <> 0 then 1 else 0 end), 6) + 0.0 as score from s""",
    "parse_stats": _values([(i, c, n) for i, (_, c, n) in enumerate(FORMULAE)], "id, code, n_lr", "cast(id as bigint) as id, cast(code as bigint) as code, cast(n_lr as bigint) as n_lr"),
    "parse_counts": _values([(len(FORMULAE), sum(c for _, c, _ in FORMULAE))], "n_parse_tex, n_parse_err", "cast(n_parse_tex as bigint) as n_parse_tex, cast(n_parse_err as bigint) as n_parse_err"),
    "json_api_codes": _values([(i, c) for i, (_, c) in enumerate(REQUESTS)], "id, code", "cast(id as bigint) as id, cast(code as bigint) as code"),
    "search_lines": _values(
        [(0, 0, "tex", "x^2 + \\qvar{x}"), (0, 1, "term", "such"), (0, 2, "term", "that"), (1, 0, "term", "prime"), (1, 1, "tex", "a,b"), (1, 2, "term", "gcd")],
        "line, place, kind, word", "cast(line as bigint) as line, cast(place as bigint) as place, kind, word",
    ),
    "incremental_append": f"with {POST} select term, count(*) as df, cast(sum(tf) as bigint) as n from post group by term",
    "append_ids": """with d as (select doc_id % 2 as part, doc_id as k, 'u' || lpad(cast(doc_id as varchar), 12, '0') as url, len(regexp_extract_all(text, '[a-zA-Z]+')) as n from documents)
select row_number() over (order by part, k) as doc_id, url, cast(n as bigint) as doc_len from d""",
    "append_stats": f"with {TOK} select count(*) as doc_n, cast(floor(sum(n) / count(*)) as bigint) as avg_doc_len, (select count(distinct term) from tok) as term_n from (select len(regexp_extract_all(text, '[a-zA-Z]+')) as n from documents)",
    "term_dictionary": f"with {TOK}, t as (select term, row_number() over (order by term) as term_id from (select distinct term from tok)) select term, term_id, case when term_id <= 3 then term end as reverse from t",
    "posting_dump": f"with {POST}, n as (select doc_id, count(*) as doc_len from tok group by doc_id) select doc_id, doc_len, cast(tf as bigint) as tf, array_to_string(pos, ' ') as pos from post join n using (doc_id) where term = 'the'",
    "path_probe": "select cast(p_partkey as bigint) as doc_id, cast(unnest([1, 2]) as bigint) as path_id, cast(2 as bigint) as n_lr from part",
    "url_lookup": f"select cast(p_partkey as bigint) as doc_id, 'http://x/7' as url, cast({len(score.MathQuery('x^2+y^3=z').elements)} as bigint) as n_elements from part where p_size = 7",
    "doc_lookup": f"with {GRID_ROWS} select doc_id, 'http://x/' || p_size as url, '[imath]x^{{' || i || '}}+y^{{' || j || '}}=z[/imath]' as text from grid join part on p_partkey = doc_id where doc_id = 5",
    "json_response": f"with {_hits(TERMS)}, s as ({MIXED_TOP}), r as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from s) select rank, cast(0 as bigint) as code, cast(ceil(n / 10) as bigint) as pages, doc_id, printf('%.3f', score) as score, {TITLE} as title from r join documents using (doc_id) where rank between 11 and 20",
    "console_page": f"with {_hits(TERMS)}, s as ({MIXED_TOP}), r as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from s) select rank, doc_id, printf('%.3f', score) as score from r where rank between 11 and 20",
    "corpus_files": """with n as (select case when n_nationkey % 5 = 1 then '' else 'n/' || n_name end as url, 'The nation of ' || n_name as text from nation)
select 'document' as kind, url, text from n where url <> '' union all select 'line', null, text from n union all select 'reject', null, 'no url' from n where url = '' union all select 'files', null, cast(count(*) as varchar) from n""",
    "stream_index": "select term, count(distinct k) as df from (select n_nationkey as k, unnest(regexp_extract_all(lower('The nation of ' || n_name), '[a-z]+')) as term from nation where n_nationkey % 5 <> 1) group by term",
    "for_pack": f"""with {POST}, w as (select *, cast({WIDTH.format("list_max(pos)")} as bigint) as width from post),
u as (select term, doc_id, width, 32 // width as fit, unnest(pos) as v, generate_subscripts(pos, 1) - 1 as i from w),
words as (select term, doc_id, width, i // fit as k, cast(sum(v * cast(2 ** (i % fit * width) as bigint)) as bigint) as word from u group by all),
hexed as (select term, doc_id, width, k, printf('%08x', word) as h from words)
select term, doc_id, printf('%02x', width) || string_agg(h[7:8] || h[5:6] || h[3:4] || h[1:2], '' order by k) as packed, true as same from hexed group by term, doc_id, width""",
    "codec_roundtrip": f"with {POST} select unnest(['for', 'for-delta', 'gzip', 'plain']) as codec, n as n_lists, true as same from (select count(*) as n from post)",
    "dictionary_lexer": "with t as (select cast(p_partkey as bigint) as doc_id, list_concat(['中文'], list_transform(range(p_size % 3), lambda x: '字典'), ['啊', 'bolt']) as l from part) select doc_id, cast(generate_subscripts(l, 1) - 1 as bigint) as pos, unnest(l) as term from t",
    "sql_functions": "select cast(p_partkey as bigint) as doc_id, cast(0 as bigint) as code, 'x <em>y</em> ' || case when length(' ' || p_partkey) > 0 then left(cast(p_partkey as varchar), length(cast(p_partkey as varchar)) - 1) end || ' ... ' as snippet, cast(100 as bigint) as marks from part",
    "snippet_fixtures": _values([*((i, want) for i, (_, want) in enumerate(SNIPPETS)), (3, "one <[imath]x+1[/imath]> <two> ... "), (4, "a < b")], "id, snippet", "cast(id as bigint) as id, snippet"),
    "lenient_lines": _values([(0, 0, "tex", "a+b"), (0, 1, "term", "word"), (1, 0, "tex", "f(x)"), (1, 1, "tex", "y"), (2, 0, "term", "plain")], "line, place, kind, word", "cast(line as bigint) as line, cast(place as bigint) as place, kind, word"),
    "merge_ops": _values([("or", 2), ("and", 1), ("xor", -1)], "op, n", "op, cast(n as bigint) as n"),
    "proximity_fixtures": _values([(1, 1), (2, 3), (3, None)], "doc_id, dist", "cast(doc_id as bigint) as doc_id, cast(dist as bigint) as dist"),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
