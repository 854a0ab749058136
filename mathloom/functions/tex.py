"""TeX formulae: lexer, operator trees and leaf-to-root paths.

``parse(tex)`` gives the paths by which a formula is indexed and searched. Symbols and hashes
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

from mathloom.functions.lalr import END, Tables
from mathloom.functions.tex_symbols import COMMANDS, SYMBOLS, letter_symbol, number_symbol

MAX_NODES = 64
OK, ERROR = 0, 1
U16 = 0xFFFF


class Node:
    """A node of the operator tree. ``flag`` is "commutative" of an operator and "wildcard" of
    a leaf: one bit for both, so an operator that ends up without operands is a wildcard (Q12)."""

    __slots__ = ("cls", "father", "flag", "fr_hash", "ge_hash", "path_id", "rank", "sons", "symbol", "under")

    def __init__(self, cls: str, kind: str, symbol: int) -> None:
        self.cls, self.flag, self.symbol = cls, kind == "C", symbol
        self.under: list[Node] = []
        self.father: Node | None = None
        self.sons = self.rank = self.path_id = self.ge_hash = 0
        self.fr_hash = symbol & U16

    def add(self, child: Node) -> None:
        """Attaches a child; one of the same class dissolves into a commutative father."""
        for c in child.under if self.flag and child.cls == self.cls else (child,):
            self.sons += 1
            c.rank, c.father = self.sons, self
            c.fr_hash = (self.fr_hash + c.symbol) & U16
            self.under.append(c)

    def walk(self) -> Iterator[Node]:
        """Post-order."""
        for c in self.under:
            yield from c.walk()
        yield self


def op(cls: str, kind: str, symbol: str) -> Node:
    return Node(cls, kind, SYMBOLS[symbol])


# ---------------------------------------------------------------- lexer

#: Character -> (terminal, class, kind, symbol)
SIGNS = {
    "+": ("ADD", "ADD", "C", "plus"),
    "±": ("ADD", "ADD", "C", "pm"),
    "-": ("NEG", "NEG", "C", "minus"),
    "*": ("VAR", "STAR", "L", "ast"),
    "/": ("DIV", "FRAC", "N", "frac"),
    "!": ("FACT", "FACT", "N", "fact"),
    "'": ("PRIME", "PRIME", "N", "prime"),
    "_": ("SUBSCRIPT", "SUBSCRIPT", "C", "subscript"),
    "^": ("SUPSCRIPT", "SUPSCRIPT", "C", "supscript"),
    "α": ("VAR", "VAR", "L", "alpha"),
    "β": ("VAR", "VAR", "L", "beta"),
    "∞": ("VAR", "INFTY", "L", "infty"),
    "|": ("VAR", "VERT", "L", "vert"),
    ",": ("SEP_CLASS", "SEP", "N", "comma"),
    ";": ("SEP_CLASS", "SEP", "N", "semicolon"),
    ":": ("SEP_CLASS", "SEP", "N", "colon"),
    "=": ("REL_CLASS", "GTLS", "C", "equal"),
    "<": ("REL_CLASS", "GTLS", "C", "lt"),
    ">": ("REL_CLASS", "GTLS", "C", "gt"),
}
LONGER = {
    "...": ("VAR", "DOTS", "L", "dots"),
    ":=": SIGNS["="],
    "\\dot=": SIGNS["="],
    "\\not=": ("REL_CLASS", "GTLS", "C", "neq"),
    "\\%": ("VAR", "PERCENT", "L", "percent"),
    "\\|": ("VAR", "VERT", "L", "Vert"),
    "\\\\": ("SEP_CLASS", "SEP", "N", "newline"),
    "\\&": ("SEP_CLASS", "SEP", "N", "And"),
    "colon": SIGNS[":"],  # Q16: the bare word
}
ROW, COLUMN = ("TAB_ROW", "TAB_ROW", "C", "row"), ("TAB_COL", "TAB_COL", "C", "column")
BRACES = {"(": "L_BRACKET", ")": "R_BRACKET", "{": "L_TEX_BRACE", "}": "R_TEX_BRACE", "[": "L_TEX_BRACKET", "]": "R_TEX_BRACKET", "\\{": "L_BRACKET", "\\}": "R_BRACKET"}
#: Commands that are brackets or only grammar.
PLAIN = {"over": "OVER", "of": "OF", "qvar": "QVAR", "stackrel": "STACKREL", "buildrel": "BUILDREL", "overset": "SET_REL", "underset": "SET_REL"}
PLAIN |= {"lgroup": "L_BRACKET", "langle": "L_ANGLE", "lmoustache": "L_HAIR", "lbrace": "L_BRACKET", "lbrack": "L_BRACKET", "lceil": "L_CEIL", "lfloor": "L_FLOOR"}
PLAIN |= {"rgroup": "R_BRACKET", "rangle": "R_ANGLE", "rmoustache": "R_HAIR", "rbrace": "R_BRACKET", "rbrack": "R_BRACKET", "rceil": "R_CEIL", "rfloor": "R_FLOOR"}
SIDE = {"(": "BRACKET", ")": "BRACKET", "[": "BRACKET", "]": "BRACKET", "{": "BRACKET", "}": "BRACKET", "<": "ANGLE", ">": "ANGLE", "/": "SLASH", "\\": "SLASH", "|": "VERT", ".": "DOT"}
SIDE |= {"\\" + a + "group": "BRACKET" for a in "lr"} | {"\\" + a + "angle": "ANGLE" for a in "lr"} | {"\\" + a + "moustache": "HAIR" for a in "lr"} | {"\\" + a + "ceil": "CEIL" for a in "lr"} | {"\\" + a + "floor": "FLOOR" for a in "lr"}
SIDE |= {"\\backslash": "SLASH"} | {f"\\{a}arrow": "ARROW" for a in ("up", "Up", "down", "Down", "updown", "Updown")}
#: What \left takes, and what \right takes, of those that are one-sided.
ONLY = {"left": ("(", "[", "{", "<", "\\lgroup", "\\langle", "\\lmoustache", "\\lceil", "\\lfloor"), "right": (")", "]", "}", ">", "\\rgroup", "\\rangle", "\\rmoustache", "\\rceil", "\\rfloor")}
BOTH = tuple(k for k in SIDE if k not in ONLY["left"] + ONLY["right"])
TAKES = {side: re.compile(r" *(" + "|".join(sorted(map(re.escape, own + BOTH), key=len, reverse=True)) + ")") for side, own in ONLY.items()}
MATRIX = re.compile(r"\\(begin|end)\{(?:[vVbBp]?matrix|smallmatrix|cases)\}")
SKIPPED = re.compile(
    r"\\begin\{(?:alignat\*?|alignedat|array|subarray)\}\{[^}]*\}"
    r"|\\(?:begin|end)\{(?:align\*?|aligned|eqnarray\*?|equation\*?|gather\*?|gathered|multline\*?|split)\}"
    r"|\\end\{(?:alignat\*?|alignedat|array|subarray)\}"
)
IGNORED = re.compile(r"\\(?:color|mbox|hbox|label|tag|text|leftroot|uproot)\{")
SPACED = frozenset("hspace hskip mspace mskip mkern kern".split())
UNIT = re.compile(r"(?:em|ex|pt|pc|mu|cm|mm|in|px)\}?")
DIGITS = re.compile(r"\\([dct]?frac|[dt]?binom) *([0-9])([0-9])")
FUNCTION = re.compile(r"\\operatorname\*?\{[^}]*\}")
NUMBER = re.compile(r"([0-9]+)(\.[0-9]*)?")
COMMAND = re.compile(r"\\[a-zA-Z]+")
LONG = re.compile("|".join(re.escape(k) for k in sorted(LONGER, key=len, reverse=True)))


def _node(entry: tuple) -> tuple[str, Node]:
    terminal, cls, kind, symbol = entry
    return terminal, Node(cls, kind, symbol if isinstance(symbol, int) else SYMBOLS[symbol])


def _number(digits: str) -> Node:
    n = min(int(digits[:12]), 1 << 32) if len(digits) < 12 else 1 << 32
    return Node("NUM", "L", number_symbol(n))


def _whole(digits: str) -> Node:
    bare = digits.lstrip("0")
    return op("ZERO", "L", "zero") if not bare else op("ONE", "L", "one") if bare == "1" else _number(bare)


def tokens(tex: str) -> Iterator[tuple[str, Node | None]]:
    """(terminal, node) of a formula; every line ends with an ``EOL``."""
    s, at, matrix, depth = tex + "\n", 0, False, 0
    while at < len(s):
        c = s[at]
        if c == "%":
            at = s.find("\n", at)
            continue
        if c == "\n":
            yield "EOL", None
            at += 1
            continue
        if c.isascii() and c.isdigit():
            m = NUMBER.match(s, at)
            if m[2] is None:
                yield "NUM", _whole(m[1])
            elif len(m[0]) < 32:
                f = op("FLOAT", "N", "float")
                f.add(_number(m[1].lstrip("0") or "0"))
                f.add(_number(m[2][1:].lstrip("0") or "0"))
                yield "NUM", f
            else:
                yield "NUM", op("ZERO", "L", "zero")
            at = m.end()
            continue
        if c == "\\":
            for found in (IGNORED.match(s, at), MATRIX.match(s, at), SKIPPED.match(s, at), DIGITS.match(s, at), FUNCTION.match(s, at)):
                if found:
                    break
            if found and found.re is IGNORED:
                at, level = found.end(), 1
                while at < len(s) and level:
                    level += {"{": 1, "}": -1}.get(s[at], 0)
                    at += 1
                matrix = False
                if level:  # the text runs to the end: the line never ends
                    return
                continue
            if found and found.re is MATRIX:
                matrix = found[1] == "begin"
                depth += 1
                yield ("BEGIN_MAT" if matrix else "END_MAT"), None
                at = found.end()
                continue
            if found and found.re is SKIPPED:
                at = found.end()
                continue
            if found and found.re is DIGITS:
                cls, sym = ("FRAC", "frac") if "frac" in found[1] else ("BINOM", "binom")
                n = op(cls, "N", sym)
                n.add(_number(found[2]))  # Q18: always NUM
                n.add(_number(found[3]))
                yield cls + "2", n
                at = found.end()
                continue
            if found:
                yield "FUN_CLASS", op("USR_FUN", "L", "usr_fun")
                at = found.end()
                continue
            if s.startswith("\\array{", at):
                matrix, depth = True, depth + 1
                yield "BEGIN_MAT", None
                at += 7
                continue
            m = COMMAND.match(s, at)
            long = LONG.match(s, at)
            if long and (not m or long.end() > m.end()):
                at = long.end()
                yield _node(ROW if matrix and long[0] == "\\\\" else LONGER[long[0]])
                continue
            if not m:
                two = s[at : at + 2]
                if two in BRACES:
                    yield BRACES[two], None
                    at += 2
                else:  # short spaces, and a backslash before anything else
                    at += 2 if two in ("\\!", "\\:", "\\;", "\\,") else 1
                continue
            name, at = m[0][1:], m.end()
            if name in ("left", "right"):
                more = TAKES[name].match(s, at)
                if more and not (more[1][0] == "\\" and len(more[1]) > 1 and s[more.end() : more.end() + 1].isalpha()):
                    at = more.end()
                    yield name[0].upper() + "_" + SIDE[more[1]], None
                else:
                    yield name[0].upper() + "_DOT", None
            elif name in PLAIN:
                yield PLAIN[name], None
            elif matrix and name in ("cr", "newline"):
                yield _node(ROW)
            elif name in SPACED or name == "above":
                if name == "above":
                    yield _node(COMMANDS[name])
                m = UNIT.search(s, at)
                at = m.end() if m else len(s)
                matrix = False
                if not m:
                    return
            elif name in COMMANDS:
                yield _node(COMMANDS[name])
            continue
        long = LONG.match(s, at)
        if long:
            at = long.end()
            yield _node(LONGER[long[0]])
        elif matrix and c in "{}&":
            depth += {"{": 1, "}": -1}.get(c, 0)
            if c == "&":
                yield _node(COLUMN)
            elif c == "}" and depth == 0:
                matrix = False
                yield "END_MAT", None
            else:
                yield BRACES[c], None
            at += 1
        elif c in BRACES:
            yield BRACES[c], None
            at += 1
        elif c.isascii() and c.isalpha():
            yield "VAR", Node("VAR", "L", letter_symbol(c))
            at += 1
        else:
            if c in SIGNS:
                yield _node(SIGNS[c])
            at += 1


# ---------------------------------------------------------------- grammar

Action = Callable[..., Node]


class Builder:
    """Semantic actions. ``root`` is the father of the last attachment, hence the last line's tree."""

    root: Node | None = None

    def join(self, father: Node, *children: Node) -> Node:
        for c in children:
            father.add(c)
        self.root = father
        return father

    def same(self, a: Node) -> Node:
        return self.join(a)

    def nothing(self) -> Node:
        return self.join(op("NIL", "L", "nil"))

    def infix(self, a: Node, o: Node, b: Node) -> Node:
        return self.join(o, a, b)

    def after(self, a: Node, o: Node) -> Node:
        return self.join(o, a)

    def minus(self, a: Node, o: Node, b: Node) -> Node:
        return self.join(op("ADD", "C", "plus"), self.join(o, b), a)

    def first(self, a: Node, _: Node) -> Node:
        return self.join(a)

    def over(self, a: Node, _: None, b: Node) -> Node:
        return self.join(op("FRAC", "N", "frac"), a, b)

    def beside(self, a: Node, b: Node) -> Node:
        return self.join(op("TIMES", "C", "times"), a, b)

    def scripted(self, a: Node, script: Node) -> Node:
        return self.join(script, self.join(op("BASE", "C", "base"), a))

    def script(self, o: Node, a: Node) -> Node:
        return self.join(op("HANGER", "C", "hanger"), self.join(o, a))

    def scripts(self, o: Node, a: Node, p: Node, b: Node) -> Node:
        return self.join(op("HANGER", "C", "hanger"), self.join(o, a), self.join(p, b))

    def inner(self, _: None, a: Node, __: None) -> Node:
        return self.join(a)

    def two(self, o: Node, a: Node, b: Node) -> Node:
        return self.join(o, a, b)

    def one(self, o: Node, a: Node) -> Node:
        return self.join(o, a)

    def root_of(self, o: Node, _: None, n: Node, __: None, a: Node) -> Node:
        return self.join(o, a, n)

    def root_by(self, o: Node, n: Node, _: None, a: Node) -> Node:
        return self.join(o, a, n)

    def wild(self, _: None, a: Node) -> Node:
        a.flag = True
        return self.join(a)

    def wild_braced(self, q: None, _: None, a: Node, __: None) -> Node:
        return self.wild(q, a)

    def bare(self, a: Node) -> Node:
        a.flag = False
        return self.join(a)

    def above(self, a: Node, _: None, __: Node, rel: Node, b: Node) -> Node:
        return self.join(rel, a, b)

    def built(self, a: Node, _: None, __: Node, ___: None, rel: Node, b: Node) -> Node:
        return self.join(rel, a, b)

    def arrow(self, a: Node, o: Node, _: Node, b: Node) -> Node:
        return self.join(o, a, b)

    def arrow_below(self, a: Node, o: Node, *rest: Node) -> Node:
        return self.join(o, a, rest[-1])

    def pass_on(self, *_: object) -> None:
        return None


for _name, _cls, _symbol in (("bracket", "GROUP", "bracket"), ("array", "GROUP", "array"), ("angle", "GROUP", "angle"), ("slash", "GROUP", "slash"), ("hair", "GROUP", "hair"), ("arrows", "GROUP", "arrow"), ("ceil", "CEIL", "ceil"), ("floor", "FLOOR", "floor"), ("verts", "VERTS", "verts")):
    setattr(Builder, _name, lambda self, _, a, __, cls=_cls, symbol=_symbol: self.join(op(cls, "C", symbol), a))

PAIRS = "L_BRACKET-R_BRACKET:bracket L_DOT-R_BRACKET:array L_BRACKET-R_DOT:array L_BRACKET-R_TEX_BRACKET:bracket L_TEX_BRACKET-R_BRACKET:bracket L_ANGLE-R_ANGLE:angle L_SLASH-R_SLASH:slash L_HAIR-R_HAIR:hair L_ARROW-R_ARROW:arrows L_TEX_BRACKET-R_TEX_BRACKET:bracket L_CEIL-R_CEIL:ceil L_FLOOR-R_FLOOR:floor L_VERT-R_VERT:verts".split()


def _sums(x: str, infixes: str) -> list[str]:
    """Rules of a sum-like symbol; ``infixes`` are binary operators between two of them."""
    out = [f"{x} = > nothing % NULL", f"{x} = term > same", f"{x} = {x} ADD term > infix", f"{x} = {x} ADD > after", f"{x} = {x} NEG term > minus", f"{x} = {x} NEG > first"]
    return out + [f"{x} = {x} {o} {x} > {'over' if o == 'OVER' else 'infix'}" for o in infixes.split()]


GRAMMAR = [
    "doc = line > pass_on",
    "doc = doc line > pass_on",
    "line = tex EOL > pass_on",
    *_sums("tex", "REL_CLASS SEP_CLASS ABOVE OVER CHOOSE"),
    "tex = tex STACKREL atom rel tex > above",
    "tex = tex BUILDREL label OVER rel tex > built",
    "tex = tex SET_REL atom rel tex > above",
    "tex = tex X_ARROW atom tex > arrow",
    "tex = tex X_ARROW L_TEX_BRACKET label R_TEX_BRACKET atom tex > arrow_below",
    "rel = atom > same",
    "rel = REL_CLASS > same",
    *_sums("label", "REL_CLASS SEP_CLASS"),
    *_sums("cells", "SEP_CLASS ABOVE OVER TAB_ROW TAB_COL"),
    "term = factor > same",
    "term = term factor > beside",
    "term = term TIMES factor > infix",
    "term = term DIV factor > infix",
    "factor = pack > same",
    "factor = factor FACT > after",
    "factor = factor PRIME > after",
    "factor = factor script > scripted",
    "pack = atom > same",
    "pack = pair > same",
    "pack = BEGIN_MAT cells END_MAT > inner",
    *(f"atom = {t} > same" for t in ("VAR", "NUM", "FUN_CLASS", "SUM_CLASS", "FRAC2", "BINOM2")),
    "atom = L_TEX_BRACE tex R_TEX_BRACE > inner",
    "atom = FRAC atom atom > two",
    "atom = BINOM atom atom > two",
    "atom = VECT atom > one",
    "atom = SQRT atom > one",
    "atom = SQRT L_TEX_BRACKET tex R_TEX_BRACKET atom > root_of",
    "atom = ROOT atom OF atom > root_by",
    "atom = atom MODULAR atom > infix",
    "atom = QVAR VAR > wild",
    "atom = QVAR L_TEX_BRACE VAR R_TEX_BRACE > wild_braced",
    "raised = atom > same",
    *(f"raised = {t} > bare" for t in ("ADD", "NEG", "TIMES")),
    "script = SUBSCRIPT raised > script",
    "script = SUPSCRIPT raised > script",
    "script = SUBSCRIPT raised SUPSCRIPT raised > scripts",
    "script = SUPSCRIPT raised SUBSCRIPT raised > scripts",
    *(f"pair = {p.split('-')[0]} tex {p.split('-')[1].split(':')[0]} > {p.split(':')[1]}" for p in PAIRS),
]
LEVELS = [("right", t) for t in "TAB_ROW TAB_COL OVER CHOOSE SEP_CLASS REL_CLASS STACKREL BUILDREL SET_REL X_ARROW ABOVE".split()]
LEVELS += [("left", "NULL"), ("left", "ADD NEG"), ("nonassoc", "FACT"), ("nonassoc", "PRIME"), ("right", "SUPSCRIPT SUBSCRIPT"), ("left", "TIMES DIV")]
LEVELS += [("right", t) for t in ("MODULAR", "BINOM", "FRAC", "VECT", "SQRT", "ROOT OF")]
LEVELS += [("nonassoc", f"L_{x} R_{x}") for x in "BRACKET DOT ANGLE SLASH HAIR ARROW TEX_BRACE TEX_BRACKET CEIL FLOOR VERT".split()]


@cache
def tables() -> Tables:
    rules = []
    for line in GRAMMAR:
        left, _, rest = line.partition(" = ")
        right, _, action = rest.partition("> ")
        action, _, level = action.partition(" % ")
        rules.append((left, tuple(right.split()), action, level or None))
    return Tables(rules, LEVELS)


def tree(tex: str) -> Node | None:
    """The operator tree of the last line (Q14), None if any line is not a formula."""
    made, t = Builder(), tables()
    states, values = [0], []
    stream = iter([*tokens(tex), (END, None)])
    terminal, node = next(stream)
    while True:
        kind, n = t.table[states[-1]].get(terminal, ("e", 0))
        if kind == "e":
            return None
        if kind == "s":
            states.append(n)
            values.append(node)
            terminal, node = next(stream)
            continue
        if n == 0:
            return made.root
        left, right, action, _ = t.rules[n]
        args = values[len(values) - len(right) :]
        del values[len(values) - len(right) :], states[len(states) - len(right) :]
        values.append(getattr(made, action)(*args))
        states.append(t.goto[states[-1]][left])


# ---------------------------------------------------------------- paths


@dataclass
class Path:
    path_id: int
    kind: str  # normal, wildcard or gener
    symbol: int  # of the leaf, or the hash of an inner node
    fr_hash: int
    tokens: list[str]

    @property
    def key(self) -> str:
        """Tokens from the leaf, or from the father of an inner node or wildcard, to the root."""
        return "/".join(self.tokens if self.kind == "normal" else self.tokens[1:])


@dataclass
class Parsed:
    code: int
    message: str
    n_lr: int = 0
    paths: list[Path] = field(default_factory=list)


def pruned(root: Node) -> Node:
    """Without NIL leaves below the root; counts and ranks stay (Q3)."""
    for n in list(root.walk()):
        n.under = [c for c in n.under if c.under or c.cls != "NIL"]
    return root


def numbered(root: Node) -> int:
    """Numbers leaves in post-order, gives a leaf's number to the lowest father of several
    that has none yet, sets hashes; returns the number of nodes, the largest id (Q1)."""
    leaf = total = 0
    for n in root.walk():
        total += 1
        if n.under:
            n.ge_hash = n.symbol * sum(c.ge_hash for c in n.under) & U16
            continue
        leaf += 1
        n.ge_hash, n.path_id = n.symbol, leaf
        up = n.father
        while up is not None and not (up.sons > 1 and up.path_id == 0):
            up = up.father
        if up is not None:
            up.path_id = leaf
    return total


def steps(n: Node) -> list[str]:
    out = []
    at: Node | None = n
    while at is not None:
        out.append(at.cls)
        if at.father is not None and not at.father.flag:
            out.append(f"rank{at.rank}")
        at = at.father
    return out


def paths(root: Node) -> tuple[int, list[Path]]:
    """Leaves, and the paths: of each leaf, and of each inner node with several sons but the root."""
    n_lr, out, seen = 0, [], set()
    for leaf in root.walk():
        if leaf.under:
            continue
        n_lr += 1
        at: Node | None = leaf
        while at is not None:
            own = at is leaf
            if own or (at.sons > 1 and at.father is not None):
                slot = at.path_id if own else at.path_id + MAX_NODES
                if slot not in seen:
                    seen.add(slot)
                    kind = ("wildcard" if at.flag else "normal") if own else "gener"
                    out.append(Path(at.path_id, kind, at.symbol if own else at.ge_hash, at.fr_hash, steps(at)))
            at = at.father
    return n_lr, out


def parse(tex: str) -> Parsed:
    root = tree(tex)
    if root is None:
        return Parsed(ERROR, "syntax error")
    if numbered(pruned(root)) > MAX_NODES:
        return Parsed(ERROR, "too many subpaths.")
    return Parsed(OK, "no error.", *paths(root))


def drawn(tex: str) -> str:
    """The operator tree as indented text, for people."""
    root = tree(tex)
    if root is None:
        return "(syntax error)"
    lines = []

    def show(n: Node, depth: int) -> None:
        lines.append("  " * depth + f"{n.cls} #{n.path_id}" + ("" if n.under else f" symbol {n.symbol}"))
        for c in n.under:
            show(c, depth + 1)

    numbered(pruned(root))
    show(root, 0)
    return "\n".join(lines)
