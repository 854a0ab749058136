"""TeX delimiters of forum posts to [imath]...[/imath]."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def dollars(text: str) -> str:
    """``$x$`` and ``$$x$$`` become formulae, ``\\$`` outside of them a dollar sign. An unclosed
    formula is dropped."""
    out, at = [], 0
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] == "$":
            out.append("$")
            at += 2
            continue
        if c != "$":
            end = at + 1
            while end < n and text[end] not in "\\$":
                end += 1
            out.append(text[at:end])
            at = end
            continue
        double = text[at + 1 : at + 2] == "$"
        start = at + 1 + double
        end = start
        while end < n and text[end] != "$":
            if text[end] == "\\" and text[end + 1 : end + 2] == "$":
                out.append("$")  # an escaped dollar counts even inside
                end += 1
            end += 1
        if end >= n:
            break
        out.append(f"[imath]{text[start:end]}[/imath]")
        at = end + 1 + double
    return "".join(out)


def normalise_dollars(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else dollars(x))

    return run(text)


def normalise_display(text: Column) -> Column:
    """``\\[x\\]``, also over several lines."""
    return F.regexp_replace(text, r"(?s)\\\[(.+?)\\\]", "[imath]$1[/imath]")


def normalise_inline(text: Column) -> Column:
    """``\\(x\\)``; of a line with several, from the first opening to the last closing one."""
    return F.regexp_replace(text, r"\\\((.+)\\\)", "[imath]$1[/imath]")


def canonical_macros(text: Column) -> Column:
    """Macros of some forums' canonical posts to common spelling."""
    for old, new in (("\\minus{}", "-"), ("\\plus{}", "+"), ("\\equal{}", "="), ("\\/", "/")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
