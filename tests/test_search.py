from __future__ import annotations

import json
import math
import re

import pytest
from pyspark.util import PythonEvalType

from mathloom.operators import index, merge, rank, score, text
from mathloom.plans.catalog import CASES
from mathloom.plans.engine import Engine, Index, with_ids
from mathloom.plans.query import Keyword
from mathloom.sources import corpus, delimiters
from mathloom.streaming.ingest import append_batch, follow

TERM_DOCS = [(1, "dog hates cat"), (2, "dog loves dog owner"), (3, "dog loves dog too"), (4, "dog in chinese is 一个字 狗")]


def of(spark, rows, lexer="eng"):
    return Index.of(spark.createDataFrame([(i, f"u{i}", t) for i, t in rows], "doc_id bigint, url string, text string"), lexer)


@pytest.fixture(scope="module")
def terms(spark):
    return Engine(of(spark, TERM_DOCS))


def test_statistics(terms):
    assert (terms.doc_n, terms.avg_len) == (4, 3)  # 3, 4, 4 and 4 words: 15 div 4
    df = {r.term: r.df for r in index.term_df(terms.index.postings).collect()}
    assert (df["dog"], df["loves"], df["cat"]) == (4, 2, 1)
    row = terms.index.postings.filter("term = 'dog' and doc_id = 2").first()
    assert (row.tf, row.pos) == (2, [0, 2])


def test_mixed_lexer(spark):
    assert Engine(of(spark, TERM_DOCS, "mix")).avg_len == 4  # 3, 4, 4 and 8: 19 div 4
    assert [r.doc_id for r in Engine(of(spark, TERM_DOCS, "mix")).search([Keyword("term", "狗")]).collect()] == [4]


def test_zero_idf_adds_no_dimension(terms):
    hits = {r.doc_id: r.score for r in terms.search([Keyword("term", "loves")]).collect()}
    assert hits.keys() == {2, 3}
    assert all(abs(v - (math.log(0.3) + 0.5)) < 1e-9 for v in hits.values())


def test_term_search(terms):
    assert sorted(r.doc_id for r in terms.term_search(["dog", "loves"], "and").collect()) == [2, 3]
    assert sorted(r.doc_id for r in terms.term_search(["cat", "loves"], "or").collect()) == [1, 2, 3]
    assert terms.term_search(["dog", "nowhere"], "and").collect() == []


def test_merge_rejects_other_ops(spark):
    with pytest.raises(ValueError, match="xor"):
        merge.merge(spark.range(1).selectExpr("id as doc_id", "id as k"), "xor", 1)


def test_unclosed_formula_gives_nothing(spark):
    rows = spark.createDataFrame([(1, "a [imath]x\n+1[/imath] B [imath]never closed"), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in text.tokens(rows).orderBy("pos").collect()] == [(1, 0, "a", None), (1, 1, "math_exp", "x +1"), (1, 2, "b", None)]


def test_position_cap(spark):
    rows = spark.createDataFrame([(1, "w " * 3000)], "doc_id int, text string")
    row = index.postings(rows).first()
    assert (row.tf, len(row.pos), row.doc_len) == (2048, 2048, 3000)


def test_bm25_length_factor_q2(spark):
    row = spark.range(1).select(score.bm25(*(score.F.lit(x) for x in (2, 1.0, 8, 4))).alias("a"), score.bm25(*(score.F.lit(x) for x in (2, 1.0, 8, 4)), frac="b").alias("b")).first()
    assert row.a == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 1.5 / 4 * 8)))
    assert row.b == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 / 4 * 8)))


@pytest.fixture(scope="module")
def formulae(spark):
    rows = [(f"[imath]{t}[/imath]", s) for _, _, docs in CASES for t, s in docs]
    return Engine(of(spark, [(i, t) for i, (t, _) in enumerate(rows, 1)]))


def test_golden_rankings(formulae):
    at = 0
    for name, query, docs in CASES:
        best = {}
        for r in formulae.math_search(query).collect():
            best[r.doc_id] = max(best.get(r.doc_id, 0), r.score)
        assert [best.get(at + i, 0) for i in range(1, len(docs) + 1)] == [s for _, s in docs], name
        at += len(docs)


def test_subexpression_level(spark):
    e = Engine(of(spark, [(1, "[imath]a+k(b+c)[/imath]")]))
    assert [(r.level, r.score) for r in e.math_search("b+c").collect()] == [(3, 33)]


def test_wildcard_needs_an_inner_node_q8(spark):
    e = Engine(of(spark, [(1, "[imath]a+bc[/imath]"), (2, "[imath]a+b[/imath]")]))
    assert {r.doc_id for r in e.math_search(r"a+\qvar{x}").collect()} == {1}


def test_bad_formula(formulae):
    with pytest.raises(ValueError, match="not a formula"):
        formulae.math_search("(")
    assert formulae.search([Keyword("tex", "(")]).collect() == []


def test_requests(formulae):
    ask = lambda page, *kw: json.loads(formulae.request(json.dumps({"page": page, "kw": [{"type": t, "str": s} for t, s in kw]})))
    got = ask(1, ("tex", "y^2-x^3"), ("term", "nothing"))
    assert (got["ret_code"], got["tot_pages"]) == (0, 1)
    assert got["hits"][0]["snippet"].startswith("<em>[imath]x^2 - y^3")
    assert ask(1, ("term", "nothing"))["ret_code"] == 3
    assert ask(2, ("tex", "y^2-x^3"))["ret_code"] == 4
    assert ask(1)["ret_code"] == 1


def test_by_url(formulae):
    rows = formulae.by_url("y^2-x^3", "u20").collect()
    assert rows and {r.url for r in rows} == {"u20"}
    assert formulae.lookup(1).first().url == "u1"
    assert formulae.terms_with_df(1).first().term == "math_exp"


def test_dense_ids(spark):
    rows = spark.createDataFrame([(f"u{i:03d}", "t") for i in range(57)], "url string, text string").repartition(5)
    got = sorted((r.doc_id, r.url) for r in with_ids(rows, 10).collect())
    assert got == [(10 + i, f"u{i:03d}") for i in range(57)]


def test_files_append_and_stream(spark, tmp_path):
    src, idx = tmp_path / "src", str(tmp_path / "index")
    (src / "deep").mkdir(parents=True)
    put = lambda p, **kw: p.write_text(json.dumps(kw))
    put(src / "a.json", url="ua", text="alpha [imath]x^2[/imath]")
    put(src / "deep" / "b.json", url="ub", text="beta\nalpha")
    put(src / "c.json", url="", text="no url")
    put(src / ".hidden.json", url="uh", text="hidden")
    (src / "d.txt").write_text("not json")
    assert sorted(r.url for r in corpus.json_corpus(spark, str(src)).collect()) == ["ua", "ub"]
    assert corpus.count_files(spark, str(src)) == 3
    assert corpus.text_corpus(spark, str(src)).first().text == "not json"
    follow(spark, str(src), idx, str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(FileNotFoundError):
        Index.open(spark, str(tmp_path / "none"))
    e = Engine(Index.open(spark, idx))
    assert e.doc_n == 2 and {r.doc_id for r in e.index.docs.collect()} == {1, 2}
    append_batch(idx, spark.createDataFrame([("uc", "gamma alpha [imath]y^2[/imath]")], "url string, text string"))
    e = Engine(Index.open(spark, idx))
    assert {r.doc_id: r.url for r in e.index.docs.collect()} == {1: "ua", 2: "ub", 3: "uc"}
    assert sorted(r.doc_id for r in e.term_search(["alpha"]).collect()) == [1, 2, 3]
    assert {r.doc_id for r in e.math_search("x^2").collect()} == {1, 3}
    Index.compact(spark, idx, str(tmp_path / "compact"))
    small = Engine(Index.open(spark, str(tmp_path / "compact")))
    assert (small.doc_n, small.avg_len, small.term_n) == (e.doc_n, e.avg_len, e.term_n)
    assert small.term_search(["alpha"]).collect() == e.term_search(["alpha"]).collect()
    corpus.write_json(e.index.docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_delimiters(spark):
    row = spark.range(1).select(
        delimiters.normalise_display(score.F.lit("\\[a\nb\\]")).alias("d"), delimiters.normalise_inline(score.F.lit("\\(a\\)")).alias("i"), delimiters.canonical_macros(score.F.lit("\\minus{}\\/")).alias("m")
    ).first()
    assert tuple(row) == ("[imath]a\nb[/imath]", "[imath]a[/imath]", "-/")


def test_top_k_ties(spark):
    rows = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (4, 0.5)], "doc_id int, score double")
    assert [r.doc_id for r in rank.top_k(rows, 3).collect()] == [2, 1, 3]


def test_sql_functions(spark):
    from mathloom.functions.register import register

    register(spark)
    row = spark.sql("select tex_parse('a+b').n_lr as n, mnc_score(array(1), array(struct(1, 1, array(1)))) as m, snippet('x y', array(1)) as s, tex_parse(null) as none").first()
    assert (row.n, row.m, row.s, row.none) == (2, 100, "x <em>y</em> ... ", None)


def test_http(formulae):
    import threading
    import urllib.request

    from mathloom.plans.server import server

    s = server(formulae, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    ask = urllib.request.Request(f"http://127.0.0.1:{s.server_port}/search", json.dumps({"page": 1, "kw": [{"type": "tex", "str": "y^2-x^3"}]}).encode())
    assert json.loads(urllib.request.urlopen(ask).read())["ret_code"] == 0
    s.shutdown()


def test_batches_count_once_and_failures_leave_no_trace(spark, tmp_path, monkeypatch):
    from mathloom.plans import storage

    path = f"file://{tmp_path}/index"  # a URI, as on a cluster
    rows = lambda *names: spark.createDataFrame([(n, f"word {n}") for n in names], "url string, text string")
    append_batch(path, rows("b", "a"), segment="batch0")
    append_batch(path, rows("b", "a"), segment="batch0")
    assert {r.doc_id: r.url for r in Index.open(spark, path).docs.collect()} == {1: "a", 2: "b"}
    # a write that fails before the end changes nothing, and is done again whole
    monkeypatch.setattr(storage, "write_text", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        append_batch(path, rows("c", "d"), segment="batch1")
    monkeypatch.undo()
    assert Engine(Index.open(spark, path)).doc_n == 2
    append_batch(path, rows("c", "d"), segment="batch1")
    e = Engine(Index.open(spark, path))
    assert {r.doc_id: r.url for r in e.index.docs.collect()} == {1: "a", 2: "b", 3: "c", 4: "d"}
    assert e.summary() == {"doc_n": 4, "avg_doc_len": 2, "term_n": 5}
    assert {r.term: r.term_id for r in e.term_ids(["word", "a", "d", "none"]).collect()} == {"a": 1, "word": 3, "d": 5}
    assert [r.term for r in e.terms_of([3]).collect()] == ["word"]
    with pytest.raises(FileExistsError):
        e.index.write(path)


def test_postings_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b [imath]x[/imath] B"), (2, None), (3, "")], "doc_id long, text string")
    post = index.postings(rows)
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, post.collect())) == [("a", 1, 1, [1], 5), ("b", 1, 3, [0, 2, 4], 5), ("math_exp", 1, 1, [3], 5)]


def test_postings_are_those_of_the_lexer(spark, monkeypatch):
    """grouped many documents at once, by bytes, they are those of ``tokens``."""
    texts = ["A[imath]x<Y[/imath]bÄc[imath]open d", "[IMATH]q[/IMATH] \u212aelvin \u0130x", None, "", "é", "a\x00B a " * 1500, "[imath] [/imath]x[imath]\n[/imath]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for chunk in (1, index.CHUNK):
        monkeypatch.setattr(index, "CHUNK", chunk)
        for lexer in ("eng", "mix"):
            want = {}
            for r in text.tokens(rows, lexer=lexer).collect():
                want.setdefault((r.term, r.doc_id), []).append(r.pos)
            post = index.postings(rows, lexer)
            assert "MapInArrow" in post._jdf.queryExecution().executedPlan().toString()
            got = post.collect()
            assert {(r.term, r.doc_id): r.pos for r in got} == {k: sorted(v)[: index.MAX_POSITIONS] for k, v in want.items()} and len(got) == len(want)
            n = {r.doc_id: r.n for r in rows.select("doc_id", text.n_tokens(score.F.col("text"), lexer).alias("n")).collect()}
            assert all(r.tf == len(r.pos) and r.doc_len == n[r.doc_id] for r in got) and n[2] == n[3] == 0


def test_an_index_reads_each_document_three_times(spark, tmp_path):
    """for docs, postings and formulae, and not again for the ranges of the last two."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, f"u{i}", t) for i, t in TERM_DOCS], "doc_id bigint, url string, text string")
    Index.of(rows.mapInArrow(counted, rows.schema)).write(str(tmp_path / "i"))
    assert seen.value == 3 * len(TERM_DOCS)


def test_formulae_stay_in_arrow(spark, monkeypatch):
    """no pandas objects of whole batches; equal formulae are parsed, and scored, once."""
    rows = [(i, f"[imath]x^{2 + i % 7}+y^{2 + i % 5}=z[/imath]" if i % 50 else None) for i in range(2500)]
    docs = spark.createDataFrame([(i, "", t) for i, t in rows], "doc_id bigint, url string, text string").coalesce(1)
    hits = Engine(Index.of(docs)).math_search("x^2+y^3=z")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    kinds = set(re.findall(r"ArrowEvalPython .*\], (\d+)", plan))
    assert kinds and kinds <= {str(PythonEvalType.SQL_SCALAR_ARROW_UDF), str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}
    got = {r.doc_id: r.score for r in hits.collect()}
    whole = {}
    for i, t in rows[1:36]:  # all combinations, one by one
        one = Engine(of(spark, [(i, t)])).math_search("x^2+y^3=z").collect() if i in (1, 5, 7, 14) else []
        whole.update({(i % 7, i % 5): r.score for r in one})
    assert len(got) == 2450 and all(got[i] == whole[i % 7, i % 5] for i in got if (i % 7, i % 5) in whole)
    kinds = spark.createDataFrame([("a+b",), (None,), ("(a",)], "tex string").coalesce(1)
    assert [(r.p.code, r.p.n_lr) for r in kinds.select(index.parsed(score.F.col("tex")).alias("p")).collect()] == [(0, 2), (0, 1), (1, 0)]


def test_a_search_shuffles_once_by_document(spark, tmp_path):
    of(spark, TERM_DOCS).write(str(tmp_path / "i"))
    e = Engine(Index.open(spark, str(tmp_path / "i")))
    plan = e.term_search(["dog", "loves"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    e.warm(["dog"])
    assert "InMemoryTableScan" in e.postings(["dog"])._jdf.queryExecution().executedPlan().toString()
    assert len(e.term_search(["dog"]).collect()) == 4
    e.warm([])
    assert e.postings(["dog"]).count() == 4 and e.dump("dog").count() == 4


def test_merged_positions_against_windows(spark):
    import random

    rnd = random.Random(1)
    rows = [(d, f"l{k}", sorted(rnd.sample(range(40), rnd.randrange(1, 6)))) for d in range(40) for k in range(rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, "doc_id int, list_id string, pos array<int>")
    long = df.select("doc_id", "list_id", score.F.explode("pos").alias("pos"))
    want = {r.doc_id: r.dist for r in score.min_distance(long).collect()}
    both = df.groupBy("doc_id").agg(score.F.collect_list(score.F.struct("list_id", "pos")).alias("l")).withColumn("m", score.merged(score.F.col("l")))
    got = both.select("doc_id", score.nearest(score.F.col("m")).alias("dist"), score.first_places(score.F.col("m")).alias("o")).collect()
    assert {r.doc_id: r.dist for r in got} == want
    assert {r.doc_id: r.o for r in got} == {r.doc_id: r.occurs for r in score.occurrences(long).collect()}


def test_segmenter(spark, tmp_path):
    from mathloom.functions.segment import Segmenter

    (tmp_path / "d.txt").write_text("狗 10 n\n个字 3\n一个 5\n", encoding="utf-8")
    cut = Segmenter.of_file(str(tmp_path / "d.txt"))
    assert cut("dog 一个字 狗[imath]x[/imath]") == ["dog", "一个", "字", "狗", "[imath]x[/imath]"]
    e = Engine(of(spark, TERM_DOCS, cut))
    hit = e.search([Keyword("term", "一个")]).collect()
    assert [r.doc_id for r in hit] == [4]
    assert "<em>一个</em>字" in e.page(hit, 1)[0]["snippet"]


def test_rejected_files(spark, tmp_path):
    for name, body in (("a", '{"url": "u", "text": "t"}'), ("b", '{"url": "u"}'), ("c", "{broken"), ("d", '{"url": "u", "text": "' + "x" * 500 + '"}')):
        (tmp_path / f"{name}.json").write_text(body)
    assert [r.url for r in corpus.json_corpus(spark, str(tmp_path), 400).collect()] == ["u"]
    got = {r.path.rsplit("/", 1)[-1]: r.reason for r in corpus.json_rejects(spark, str(tmp_path), 400).collect()}
    assert got == {"b.json": "no text", "c.json": "not JSON", "d.json": "too large"}
