"""Lexers with a dictionary, for text without blanks between words."""

from __future__ import annotations

import re
from collections.abc import Iterable

PARTS = re.compile(r"\[imath\].*?(?:\[/imath\]|\Z)|[a-zA-Z]+|[^\x00-\x7f]+", re.S)


class Segmenter:
    """Cuts runs of characters outside ASCII into the longest words of a dictionary, from left
    to right; a character at which no word begins is a token of its own. Formulae and runs of
    letters are tokens as in the other lexers."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(w for w in words if w)
        self.longest = max(map(len, self.words), default=1)

    @classmethod
    def of_file(cls, path: str) -> Segmenter:
        """A dictionary file: the first field of each line is a word."""
        with open(path, encoding="utf-8") as f:
            return cls(line.split()[0] for line in f if line.strip())

    def __call__(self, text: str) -> list[str]:
        out = []
        for m in PARTS.finditer(text):
            part = m.group()
            if part[0] < "\x80":
                out.append(part)
                continue
            at = 0
            while at < len(part):
                n = next((n for n in range(min(self.longest, len(part) - at), 1, -1) if part[at : at + n] in self.words), 1)
                out.append(part[at : at + n])
                at += n
        return out
