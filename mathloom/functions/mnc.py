"""Mark-and-cross: how well a document formula's symbols can stand for a query's.

Query paths come with equal symbols together, larger groups first. For each group the
document symbol ("slot") that covers most of its paths wins; its marked document paths are
crossed out and can't be used again. A path counts MARK, one more if the symbols are equal.
A query path that finds no free document path makes the whole score 0 (Q19), the first slot
to reach the maximum wins (Q20).
"""

from __future__ import annotations

from collections.abc import Iterable

MARK = 99


def mnc_score(query: list[int], relevance: Iterable[tuple[int, int, Iterable[int]]]) -> int:
    """``query``: symbols in order. ``relevance``: (symbol, path id, query paths counted from
    1) of document paths, in posting order; the order gives the slots theirs."""
    slots: dict[int, int] = {}
    rows: list[dict[int, int]] = [{} for _ in query]
    for symbol, path_id, own in relevance:
        j = slots.setdefault(symbol, len(slots))
        for k in own:
            rows[k - 1][j] = rows[k - 1].get(j, 0) | 1 << ((path_id - 1) & 63)
    symbols = list(slots)
    crossed = [0] * len(symbols)
    marked = [0] * len(symbols)
    score = [0] * len(symbols)
    total, top, best = 0, 0, 0
    for i, symbol in enumerate(query):
        none = True
        for j in range(len(symbols)):
            free = rows[i].get(j, 0) & ~(marked[j] | crossed[j])
            if not free:
                continue
            none = False
            marked[j] |= free & -free
            score[j] += MARK + (symbol == symbols[j])
            if score[j] > top:
                top, best = score[j], j
        if none:
            return 0
        if i + 1 == len(query) or query[i + 1] != symbol:
            crossed[best] |= marked[best]
            total += top
            marked, score = [0] * len(symbols), [0] * len(symbols)
            top = best = 0
    return total
