from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.functions import codec, snippets
from mathloom.functions.lalr import END, Tables
from mathloom.operators.rank import page_window
from mathloom.plans import catalog
from mathloom.plans.query import Keyword, by_df, classified, parse_request, split_raw, unique
from mathloom.sources.delimiters import dollars
from mathloom.sources.html import page_text


@given(st.lists(st.integers(0, 2**32 - 1)))
@settings(max_examples=200, deadline=None)
def test_frame_of_reference(values):
    assert codec.unpack(codec.pack(values), len(values)) == values


@given(st.lists(st.integers(0, 2**31 - 1)).map(sorted))
@settings(max_examples=100, deadline=None)
def test_frame_of_reference_delta(values):
    assert codec.unpack_delta(codec.pack_delta(values), len(values)) == values


@given(st.lists(st.integers(0, 2**31 - 1)).map(sorted), st.sampled_from(sorted(codec.CODECS)))
@settings(max_examples=100, deadline=None)
def test_codecs_by_name(values, name):
    pack, unpack = codec.CODECS[name]
    assert unpack(pack(values), len(values)) == values


def test_widths():
    assert [codec.width(x) for x in (0, 3, 15, 31, 63, 255, 1023, 65535, 2**31)] == [2, 2, 4, 5, 6, 8, 10, 16, 32]
    assert codec.unpack(codec.pack([0, 0x80000000]), 2) == [0, 0x80000000]


def test_snippet_joins_neighbours_and_trims():
    text = "a" * 10 + "KEY" + "b" * 5 + "WORD" + "c" * 10
    assert snippets.snippet(text, [(10, 13), (18, 22)], "<", ">", 8) == "a" * 8 + "<KEY>" + "b" * 5 + "<WORD>" + "c" * 7 + " ... "


def test_snippet_loses_its_last_character_q6():
    assert snippets.snippet("xxKEYabé", [(2, 5)], "<", ">", 4) == "xx<KEY>ab ... "
    assert snippets.snippet("éKEY\nz\r", [(2, 5)], "<", ">", 1) == "<KEY> ... "


def test_highlight_counts_formulae():
    text = "one [imath]x+1[/imath] two"
    assert snippets.highlighted(text, [1, 2], "<", ">") == "one <[imath]x+1[/imath]> <two> ... "
    assert snippets.highlighted("[imath]open", [0]) == ""


def test_title():
    assert snippets.title("T\n\nbody") == "T"
    assert snippets.title("no blank line") == "No title available."


def test_pages():
    assert page_window(23, 3) == (20, 23, 3)
    assert page_window(23, 4) == (0, 0, 3)
    assert page_window(0, 1) == (0, 0, 0)
    assert page_window(5, 1, 3) == (0, 3, 2)


def test_query_lines():
    assert split_raw("a,$b,c$,d") == ["a", "$b,c$", "d"]
    assert classified("$x+?$, Two words") == [Keyword("tex", "x+\\qvar{x}"), Keyword("term", "two"), Keyword("term", "words")]
    assert classified("a+b", lenient=True) == [Keyword("tex", "a+b")]


def test_order_and_repeats():
    words = [(Keyword("term", t), df, i) for t, df, i in (("dog", 90800, 1234), ("ni", 1300, 1235), ("the", 9999999, 1234))] + [(Keyword("tex", "x"), 0, 0)]
    assert [w.text for w, *_ in unique(by_df(words))] == ["x", "ni", "dog"]


@pytest.mark.parametrize(("body", "code"), [("[]", 2), ('{"page": true, "kw": []}', 2), ('{"page": 2, "kw": [{"type": "term", "str": "12"}]}', 1)])
def test_requests(body, code):
    assert parse_request(body)[0] == code


@pytest.mark.parametrize(
    ("raw", "out"),
    [("a $x$ b", "a [imath]x[/imath] b"), ("$$x$$", "[imath]x[/imath]"), (r"\$5", "$5"), ("open $x", "open "), (r"\alpha $y$", r"\alpha [imath]y[/imath]"), ("", "")],
)
def test_dollars(raw, out):
    assert dollars(raw) == out


def test_html():
    page = "<html><style>p{}</style><h1>T <b>x</b></h1><p>one &amp; two<p>three</p><div><span class='comment-copy'>said</span></div>out</html>"
    assert page_text(page) == "T x\n\none & two\nthree\nsaid\n"
    assert page_text("<div id=q><p>in</p></div><p>out</p>", only="q") == "\n\nin\n"


def test_html_references_end_with_a_semicolon():
    """As in the SQL of html_text: others, and unknown ones, stand as they are; a hard blank is text."""
    page = "<h1>a &amp;&amp</h1><p>x &copy y &copy; &notit; &lt;b&gt; &#39;&#39 & &amp;lt;</p><p>&nbsp;</p><p> \t</p>"
    assert page_text(page) == "a &&amp\n\nx &copy y \xa9 &notit; <b> '&#39 & &lt;\n\xa0\n"


def test_tables_resolve_conflicts():
    rules = [("e", ("e", "+", "e"), "", None), ("e", ("e", "*", "e"), "", None), ("e", ("n",), "", None)]
    t = Tables(rules, [("left", "+"), ("right", "*")])
    random.seed(1)

    def tree(tokens):
        states, vals = [0], []
        it = iter([*tokens, END])
        tok = next(it)
        while True:
            kind, n = t.table[states[-1]][tok]
            if kind == "s":
                states.append(n)
                vals.append(tok)
                tok = next(it)
            elif n == 0:
                return vals[0]
            else:
                left, right, *_ = t.rules[n]
                args = vals[-len(right) :]
                del vals[-len(right) :], states[-len(right) :]
                vals.append(args[0] if len(args) == 1 else tuple(args))
                states.append(t.goto[states[-1]][left])

    assert tree("n+n+n") == (("n", "+", "n"), "+", "n")
    assert tree("n*n*n") == ("n", "*", ("n", "*", "n"))
    assert tree("n+n*n") == ("n", "+", ("n", "*", "n"))


def test_lists_are_packed_together():
    """the codecs of many lists at once give the bytes of one list at a time; short lists get a
    small zlib window, which any reader takes."""
    rnd = random.Random(2)
    lists = [[], *(sorted(rnd.choices(range(2 ** rnd.choice((2, 5, 8, 16, 32))), k=rnd.choice((0, 1, 2, 9, 50)))) for _ in range(300)), []]
    values, sizes = np.array([v for x in lists for v in x], np.int64), np.array([len(x) for x in lists])
    for name, (pack, _) in codec.CODECS.items():
        data, length = codec.to_bytes(values, sizes, name)
        assert data.tobytes() == b"".join(map(pack, lists)) and length.tolist() == [len(pack(x)) for x in lists]
        assert codec.of_bytes(data, length, sizes, name).tolist() == values.tolist()
    assert codec.pack_gzip([7])[0] == 0x18 and zlib.decompress(codec.pack_gzip([7])) == codec.pack_plain([7])


def test_codec_columns(spark):
    rows = [([0, 5, 70000],), ([],), (None,), ([3],)]
    df = spark.createDataFrame(rows, "x array<int>").coalesce(1)
    for name in codec.CODECS:
        assert [r.y for r in df.select(codec.unpacked(codec.packed(F.col("x"), name), F.size("x"), name).alias("y")).collect()] == [r[0] for r in rows]
    got = df.select(codec.deltas(F.col("x")).alias("d"), codec.restored(codec.deltas(F.col("x"))).alias("r"), codec.round_trips(F.col("x")).alias("s")).collect()
    assert [r.d for r in got] == [[0, 5, 69995], [], None, [3]] and [r.r for r in got] == [r[0] for r in rows]
    assert all(r.s == [True] * 4 for r in got)


def test_codecs_read_the_documents_once(spark, sf):
    """not once for each codec."""
    plan = catalog.codec_roundtrip(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
