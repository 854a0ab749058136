"""Highlighted snippets of the documents on a result page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

PADDING = 320
FORMULA_OR_WORD = re.compile(r"\[imath\].*?(?:\[/imath\]|\Z)|[a-zA-Z]+", re.S)
MIXED = re.compile(r"\[imath\].*?(?:\[/imath\]|\Z)|[a-zA-Z]+|[^\x00-\x7f]", re.S)


def segments(text: str, lexer: str | Callable[[str], list[str]] = "eng") -> list[tuple[int, int]]:
    """Byte ranges of a text's tokens in order of position."""
    out, at, chars = [], 0, 0
    for start, end in _tokens(text, lexer):
        token = text[start:end]
        if token.startswith("[imath]") and not token.endswith("[/imath]"):
            continue
        at += len(text[chars:start].encode())
        n = len(token.encode())
        out.append((at, at + n))
        at, chars = at + n, end
    return out


def _tokens(text: str, lexer: str | Callable[[str], list[str]]) -> Iterator[tuple[int, int]]:
    if not callable(lexer):
        yield from (m.span() for m in (FORMULA_OR_WORD if lexer == "eng" else MIXED).finditer(text))
        return
    at = 0
    for token in lexer(text):
        at = text.index(token, at)
        yield at, at + len(token)
        at += len(token)


def spaced(formula: str) -> str:
    """A formula for a page: blanks around each ``<``, so that none begins a tag."""
    return formula.replace("<", " < ")


def _starts(byte: int) -> bool:
    return byte & 0xC0 != 0x80


def _head(raw: bytes) -> bytes:
    """Without continuation bytes in front."""
    i = next((i for i, b in enumerate(raw) if _starts(b)), len(raw))
    return raw[i:]


def _tail(raw: bytes) -> bytes:
    """Without the last character, complete or not (Q6)."""
    i = len(raw) - 1
    while i > 0 and not _starts(raw[i]):
        i -= 1
    return raw[: max(i, 0)]


def snippet(text: str, marks: list[tuple[int, int]], opened: str = "<em>", closed: str = "</em>", padding: int = PADDING) -> str:
    """``marks``: byte ranges to highlight, ascending. Each gets ``padding`` bytes around it;
    neighbours that would overlap are joined, others are followed by " ... "."""
    raw = text.encode()
    left = [min(padding, s) for s, _ in marks]
    right = [padding] * len(marks)
    joint_left, joint_right = [False] * len(marks), [False] * len(marks)
    for i in range(len(marks) - 1):
        end, start = marks[i][1], marks[i + 1][0]
        if start - left[i + 1] < end + right[i]:
            right[i] = min(padding, start - end)
            left[i + 1] = start - (end + right[i])
            joint_right[i] = joint_left[i + 1] = True

    def plain(part: bytes) -> str:
        return part.decode("utf-8", "replace").replace("\n", " ").replace("\r", " ")

    out = []
    for i, (start, end) in enumerate(marks):
        before, after = raw[start - left[i] : start], raw[end : end + right[i]]
        before = before if joint_left[i] else _head(before)
        after = after if joint_right[i] else _tail(after)
        out.append(plain(before) + opened + raw[start:end].decode("utf-8", "replace") + closed + plain(after))
        if not joint_right[i]:
            out.append(" ... ")
    return "".join(out)


def highlighted(text: str, occurs: list[int], opened: str = "<em>", closed: str = "</em>", lexer: str | Callable[[str], list[str]] = "eng") -> str:
    """The snippet of the tokens whose positions are in ``occurs``."""
    got = segments(text, lexer)
    return snippet(text, [got[p] for p in sorted(set(occurs)) if p < len(got)], opened, closed)


def title(text: str) -> str:
    at = text.find("\n\n")
    return text[:at] if at >= 0 else "No title available."
