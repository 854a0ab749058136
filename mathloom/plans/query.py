"""Queries: keywords, their validation, and the JSON request."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

MAX_TEX, MAX_TERMS = 4, 20
MESSAGES = (
    "Successful",
    "Empty or unrecognized query",
    "Invalid query JSON",
    "No hit found",
    "Illegal page number",
    "Rank window calculation error",
    "Too many math keywords",
    "Too many term keywords",
)
WORDS = re.compile(r"[a-zA-Z]+")
MIXED = re.compile(r"[a-zA-Z]+|[^\x00-\x7f]")
LENIENT = frozenset(".'+-*/\\!^_%()[]:;{}=<>")


@dataclass(frozen=True)
class Keyword:
    kind: str  # term or tex
    text: str


def term_keywords(text: str, lexer: str | Callable[[str], list[str]] = "eng") -> list[Keyword]:
    """A term string's own tokens (Q11: like documents, also in "mix")."""
    found = [w for w in lexer(text) if not w.startswith("[imath]")] if callable(lexer) else (WORDS if lexer == "eng" else MIXED).findall(text)
    return [Keyword("term", w.lower()) for w in found]


def parse_request(body: str, lexer: str | Callable[[str], list[str]] = "eng") -> tuple[int, int, list[Keyword]]:
    """(return code, page, keywords) of {"page": n, "kw": [{"type", "str"}]}."""
    bad = (2, 0, [])
    try:
        got = json.loads(body)
    except ValueError:
        return bad
    page = got.get("page") if isinstance(got, dict) else None
    if isinstance(page, bool) or not isinstance(page, int | float) or page < 1 or page != int(page):  # Q22
        return bad
    rows = got.get("kw")
    if not isinstance(rows, list):  # Q26
        return bad
    words: list[Keyword] = []
    for row in rows:
        if not isinstance(row, dict) or not isinstance(row.get("str"), str) or row.get("type") not in ("term", "tex"):
            return bad
        words += [Keyword("tex", row["str"])] if row["type"] == "tex" else term_keywords(row["str"], lexer)
    return checked(words), int(page), words


def checked(words: list[Keyword]) -> int:
    if not words:
        return 1
    if sum(w.kind == "tex" for w in words) > MAX_TEX:
        return 6
    return 7 if sum(w.kind == "term" for w in words) > MAX_TERMS else 0


def split_raw(raw: str) -> list[str]:
    """A search line cut at the commas outside of $...$."""
    out, now, inside = [], "", False
    for c in raw:
        inside ^= c == "$"
        if c == "," and not inside:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def classified(raw: str, lenient: bool = False, lexer: str | Callable[[str], list[str]] = "eng") -> list[Keyword]:
    """Keywords of a search line: ``$...$`` is TeX with ``?`` as wildcard, the rest are terms;
    ``lenient`` takes anything with an operator in it for TeX."""
    out: list[Keyword] = []
    for part in split_raw(raw):
        kw = part.strip()
        if kw.startswith("$") or (lenient and kw and any(c in LENIENT for c in kw)):
            out.append(Keyword("tex", kw.strip("$").replace("?", "\\qvar{x}")))
        elif kw:
            out += term_keywords(kw, lexer)
    return out


def by_df(words: list[tuple[Keyword, int, int]]) -> list[tuple[Keyword, int, int]]:
    """(keyword, df, id) by ascending df, TeX (df 0) first; stable."""
    return sorted(words, key=lambda w: 0 if w[0].kind == "tex" else w[1])


def unique(words: list[tuple[Keyword, int, int]]) -> list[tuple[Keyword, int, int]]:
    """The first of each id; id 0 (TeX, unknown terms) is always kept."""
    seen: set[int] = set()
    out = []
    for w in words:
        if w[2] and w[2] in seen:
            continue
        seen.add(w[2])
        out.append(w)
    return out
