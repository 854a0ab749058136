from __future__ import annotations

import pytest

from mathloom.functions import tex
from mathloom.functions.mnc import mnc_score
from mathloom.functions.tex_symbols import SYMBOLS


def keys(formula):
    return [(p.kind, p.key, p.path_id) for p in tex.parse(formula).paths]


def test_worked_example():
    p = tex.parse("a+k(b+c)")
    assert p.n_lr == 4
    assert keys("a+k(b+c)") == [
        ("normal", "VAR/ADD", 1), ("normal", "VAR/TIMES/ADD", 2), ("gener", "ADD", 2), ("normal", "VAR/ADD/GROUP/TIMES/ADD", 3), ("gener", "GROUP/TIMES/ADD", 3), ("normal", "VAR/ADD/GROUP/TIMES/ADD", 4),
    ]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [
        ("a-b", ["VAR/NEG/ADD", "VAR/ADD"]),  # the negated term comes first
        ("a b / c d", ["VAR/TIMES/rank1/FRAC/TIMES", "VAR/TIMES/rank1/FRAC/TIMES", "VAR/rank2/FRAC/TIMES", "VAR/TIMES"]),
        (r"a \over b", ["VAR/rank1/FRAC", "VAR/rank2/FRAC"]),
        (r"\sqrt[3]{x}", ["VAR/rank1/ROOT", "NUM/rank2/ROOT"]),
        (r"\root 3 \of x", ["VAR/rank1/ROOT", "NUM/rank2/ROOT"]),
        ("x!", ["VAR/rank1/FACT"]),
        ("x'", ["VAR/rank1/PRIME"]),
        ("x_1^2", ["ONE/SUBSCRIPT/HANGER", "NUM/SUPSCRIPT/HANGER", "VAR/BASE/HANGER"]),
        (r"\frac12", ["NUM/rank1/FRAC", "NUM/rank2/FRAC"]),  # Q18
        ("3.14", ["NUM/rank1/FLOAT", "NUM/rank2/FLOAT"]),
        ("a,b", ["VAR/rank1/SEP", "VAR/rank2/SEP"]),
        (r"\vec{v}", ["VAR/rank1/VECT"]),
        (r"\left|x\right|", ["VAR/VERTS"]),
        (r"\lceil x \rceil", ["VAR/CEIL"]),
        (r"\lfloor x \rfloor", ["VAR/FLOOR"]),
        (r"\stackrel{a}{=} b", ["VAR/GTLS"]),
        (r"\begin{matrix} a & b \\ c & d \end{matrix}", ["VAR/TAB_COL/TAB_ROW"] * 4),
        (r"a \bmod n", ["VAR/rank1/MODULAR", "VAR/rank2/MODULAR"]),
        (r"\text{if } x \color{red}", ["VAR"]),
        (r"\hspace{2em} x", ["VAR"]),
        (r"\undefinedthing x", ["VAR"]),
        ("a<b=c", ["VAR/GTLS"] * 3),  # Q17: one flat node
        (r"a^*", ["STAR/SUPSCRIPT/HANGER", "VAR/BASE/HANGER"]),
        (r"\binom n k", ["VAR/rank1/BINOM", "VAR/rank2/BINOM"]),
        ("x % comment", ["VAR"]),
    ],
)
def test_leaf_paths(formula, expected):
    assert [p.key for p in tex.parse(formula).paths if p.kind == "normal"] == expected


def test_nil_children_keep_their_rank_q3():
    root = tex.pruned(tex.tree("-b"))
    assert root.cls == "ADD" and root.sons == 2 and len(root.under) == 1


def test_operator_without_operands_is_a_wildcard_q12():
    assert tex.parse("+").paths[0].kind == "wildcard"
    assert [p.kind for p in tex.parse("a^+").paths] == ["normal", "normal"]


def test_node_limit_counts_inner_nodes_q1():
    assert tex.parse("x" * 63).code == tex.OK
    assert (tex.parse("x" * 64).code, tex.parse("x" * 64).message) == (tex.ERROR, "too many subpaths.")


@pytest.mark.parametrize("bad", ["(a", "a)", "}", r"\frac a", "a_", r"\sqrt", r"\text{never closed"])
def test_errors(bad):
    assert tex.parse(bad).code == tex.ERROR


def test_last_line_counts_q14():
    assert [p.key for p in tex.parse("a+b\nc").paths] == ["VAR"]


def test_bare_colon_q16():
    assert [p.key for p in tex.parse("acolonb").paths] == ["VAR/rank1/SEP", "VAR/rank2/SEP"]
    assert [p.key for p in tex.parse(r"\colon b").paths] == ["VAR"]


def test_symbol_numbers():
    assert len(SYMBOLS) == 453
    assert SYMBOLS["propto"] < SYMBOLS["alpha"] < SYMBOLS["plus"]  # later rows first
    assert tex.parse("70000").paths[0].symbol == SYMBOLS["bignum"]


def test_drawn():
    assert tex.drawn("a+b").splitlines()[0].startswith("ADD")
    assert tex.drawn("(") == "(syntax error)"


def test_mark_and_cross():
    # b b b a a 1 against 17 document paths of the published fixture's kind: three slots
    assert mnc_score([1, 1, 2], [(1, 1, [1, 2]), (1, 2, [1, 2]), (2, 3, [3])]) == 300
    assert mnc_score([1, 1, 2], [(7, 1, [1, 2]), (7, 2, [1, 2]), (8, 3, [3])]) == 297
    assert mnc_score([1, 2], [(1, 1, [1])]) == 0  # Q19
    assert mnc_score([], []) == 0


def test_first_slot_to_reach_the_maximum_wins_q20():
    # 2 may be matched in both slots with the same gain; the earlier one is crossed
    assert mnc_score([2, 3], [(5, 1, [1, 2]), (6, 2, [1, 2])]) == 198
    assert mnc_score([2, 3], [(3, 1, [1, 2]), (6, 2, [1, 2])]) == 198
    assert mnc_score([2, 3], [(6, 2, [1, 2]), (3, 1, [1, 2])]) == 199
