"""Benchmark decontamination by latent semantic retrieval.

Which documents hold a benchmark item, word for word or changed in places?

1. Terms are the benchmark's words. In how many passages (``PASSAGE`` words of a document) each
   occurs is counted over all documents; they weigh their inverse frequency, which makes common
   ones light but leaves none out.
2. The term-passage matrix A of all documents' passages and the benchmark's is factorised by
   distributed randomised SVD: executors sum A'(A W) for a random W, and the driver, which only
   sees terms x ``RANK`` numbers, takes the leading directions of its range by Nystroem's
   formula. Each term gets a vector of ``RANK`` latent dimensions. The words of the benchmark
   in each document are kept as numbers from the first pass to the second.
3. Every document is searched whole, as the numbers of its terms, some documents at a time.
   Windows of ``WINDOWS`` words, by the length of the item, move over it in steps of a quarter
   of their length; the sum of a window's term vectors is compared with every passage of the
   benchmark by one matrix product, and a cosine of ``COSINE`` makes a candidate. Windows that
   hold too little of any passage's weight to be one are passed over before that.
   Besides, items of any length are found wherever all their words stand in sequence: at each
   occurrence of an item's heaviest word the others are compared.
4. A candidate is checked word by word: the longest common subsequence of the item's words and
   the words around the window must cover ``EXACT`` of the item, or ``CLOSE`` of it when its
   answer (the words of its last sentence, at least ``ANSWER_WORDS``) is covered likewise.

``word`` is the number of the document's words before the place: where the sequence starts.

The driver holds the benchmark: its words as numbers, and ``RANK`` numbers of 8 bytes for each of
its terms and passages; executors get these once as a broadcast. A worker holds one text at a
time and 4 bytes for each of its words, beside about ``PIECE`` bytes of the texts before it
(``FOR_TERM`` for each term, if that is more).

Defined results: null and empty texts, and items without words, are never found; repeated
documents are each reported; a document is reported once for each item, with its best cover
(then the first place of it); an empty benchmark finds nothing. Items with an equal item_id are
items of their own, of which the best is reported. The search needs each document alone;
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import common
from mathloom.llm.common import checkpointed

PASSAGE, RANK, OVER = 48, 128, 16
#: Words of documents whose terms are kept and summed together, at least.
TOGETHER = 1 << 15
#: Passages that are summed together; a term with so many occurrences in them is a column of a dense matrix.
SUMMED, COMMON = 1024, 24
#: So many tasks' partial sums are added first.
SUMS = 64
COSINE, MASS = 0.52, 0.35
EXACT, CLOSE, ANSWER_WORDS = 0.7, 0.5, 6
#: Lengths of the windows in words, multiples of the one before; each moves by a quarter of its length.
WINDOWS = (12, 24, 48)
#: Documents are searched together up to so many words.
GROUP = 1 << 15
#: Candidates that are checked together.
CHECKED = 4096
#: Texts are cut into words in pieces of about so many characters, and together up to so many bytes, or so many for each term.
PIECE, FOR_TERM = 1 << 20, 16
FOLD = bytes((c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32) for c in range(256))
SENTENCE = re.compile(r"[.!?]\s")
BLANK = re.compile(r"\s", re.A)


def folded(text: str) -> bytes:
    """Words in lower case between blanks."""
    return text.lower().encode("utf-8", "replace").translate(FOLD)


def words(text: str) -> list[bytes]:
    return folded(text).split()


def pieces(text: str) -> Iterator[str]:
    """The text in parts that end before white space, where there is any."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def numbers_of(texts: Iterator[str | None], terms: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, in order, the term number of each of its words, -1 for words that are no
    terms. Arrow cuts and looks up the words of many texts at once; as it makes a table of all
    terms each time, their bytes grow with the terms."""
    table = pa.array(terms, pa.binary())
    most = max(PIECE, FOR_TERM * len(terms))
    parts: list[bytes] = []
    ends: list[int] = []  # of each text that is over, the number of parts so far
    many = 0
    begun: list[np.ndarray] = []  # of a text that is not over

    def looked_up() -> Iterator[np.ndarray]:
        cut = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).cast(pa.string(), safe=False))
        found = pc.index_in(cut.flatten().cast(pa.binary()), value_set=table).fill_null(-1).to_numpy()
        edge = cut.offsets.to_numpy()
        first = 0
        for end in ends:
            begun.append(found[edge[first] : edge[end]])
            yield begun[0] if len(begun) == 1 else np.concatenate(begun)
            begun.clear()
            first = end
        if first < len(parts):
            begun.append(found[edge[first] :])

    for text in texts:
        for piece in pieces(text or ""):
            # Arrow makes an empty word before a blank at the start, and of an empty text
            if part := folded(piece).strip():
                parts.append(part)
                many += len(part)
            if many >= most:
                yield from looked_up()
                parts, ends, many = [], [], 0
        ends.append(len(parts))
    yield from looked_up()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def made_item(item_id: int, text: str) -> Item:
    own = words(text)
    cut = [m.end() for m in SENTENCE.finditer(text.rstrip())]
    answer = words(text[cut[-1] :]) if cut else own
    if len(answer) < ANSWER_WORDS:
        answer = own[-ANSWER_WORDS:]
    return Item(item_id, own, answer)


def bit_masks(of: list) -> dict:
    out: dict = {}
    for i, w in enumerate(of):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(masks: dict, n: int, of: list) -> int:
    """Longest common subsequence of ``n`` words, given by bit masks, and ``of``."""
    full = (1 << n) - 1
    v = full
    get = masks.get
    for w in of:
        m = get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Target:
    """An item as the search knows it."""

    item_id: int
    ids: np.ndarray
    masks: dict[int, int]
    answer: int
    answer_masks: dict[int, int]
    lap: int  # step of its windows
    before: int  # words before and after a window's start that are compared with it
    after: int


@dataclass
class Model:
    place: dict[bytes, int]  # term -> row of vectors and weight
    weight: np.ndarray  # with a last 0
    vectors: np.ndarray  # terms x RANK: weighted right singular vectors; a last row of zeros
    targets: list[Target]
    kinds: list[tuple[int, np.ndarray, np.ndarray, float]]  # width of windows: its passages, their targets, their least weight
    anchors: dict[int, list[tuple[int, int]]]  # heaviest term -> targets, and its place in them
    anchor: np.ndarray  # terms and, for other words, one more: whether it is in anchors


def numbered(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """All documents' occurrences of terms: (ids, sizes), term numbers in order of passages and
    how many each passage has; and a row of each partition with its (found), by term the passages
    that have it, then all its passages."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n + 1, np.int64)
        held: list[np.ndarray] = []
        many = 0

        def row(ids: bytes | None, sizes: bytes | None, found: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids, sizes, found)], names=["ids", "sizes", "found"])

        def flushed() -> pa.RecordBatch:
            words = np.array([len(own) for own in held], np.int64)
            passages = -(-words // PASSAGE)
            found[n] += passages.sum()
            own = np.concatenate(held)
            at = np.flatnonzero(own >= 0)
            # a document's words are counted from its start, and its passages from those before it
            start, before = np.cumsum(words) - words, np.cumsum(passages) - passages
            doc = np.repeat(np.arange(len(held)), words)[at]
            number = (at - start[doc]) // PASSAGE + before[doc]
            ids = own[at].astype(kind(n))
            order = np.argsort(ids, kind="stable")
            s, p = ids[order], number[order]
            found[:n] += np.bincount(s[np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])])[: len(s)]], minlength=n)
            sizes = np.bincount(number)
            return row(ids.tobytes(), sizes[sizes > 0].astype(np.uint8).tobytes(), None)

        for own in numbers_of((text.as_py() for batch in batches for text in batch.column(0)), shared.value):
            held.append(own)
            many += len(own)
            if many >= TOGETHER:
                yield flushed()
                held, many = [], 0
        if many:
            yield flushed()
        yield row(None, None, found.tobytes())

    return checkpointed(common.map_arrow(documents.select("text"), run, "ids binary, sizes binary, found binary"))


def kind(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def counted(numbers: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Passages with each of ``n`` terms, and all passages, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n + 1, np.int64)
        for batch in batches:
            for found in batch.column(0):
                out += np.frombuffer(found.as_py(), np.int64)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["term", "n"])

    rows = common.map_arrow(numbers.filter("found is not null").select("found"), run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out[:n], int(out[n])


def run_sums(cells: np.ndarray, rows: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each start and count, which is at least 1, the sum of as many of ``cells[rows]`` from
    there on. (np.add.reduceat takes ten times as long for rows.)"""
    order = np.argsort(-count, kind="stable")
    first, left = start[order], count[order]
    out = cells[rows[first]]
    for j in range(1, int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j))  # so many are longer than j
        out[:k] += cells[rows[first[:k] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return start, np.diff(start, append=len(values))


def add_products(out: np.ndarray, scaled: np.ndarray, ids: np.ndarray, number: np.ndarray, passages: int) -> None:
    """``out`` += C'(C scaled), with C the term counts of some passages: of ``ids``, each in passage
    ``number``, which rises. Common terms go through dense products, others row by row."""
    order = np.argsort(ids, kind="stable")
    start, count = runs(ids[order])
    term = ids[order][start].astype(np.int64)
    often = count >= COMMON
    width = int(often.sum())
    column = np.full(len(term), -1)
    column[often] = np.arange(width)
    at = np.empty(len(ids), np.int64)  # by occurrence
    at[order] = np.repeat(column, count)
    dense = at >= 0
    c = np.bincount(number[dense] * width + at[dense], minlength=passages * width).astype(np.float32).reshape(passages, width)
    by_row = c @ scaled[term[often]]
    rest, own = ids[~dense], number[~dense]
    first, many = runs(own)
    by_row[own[first]] += run_sums(scaled, rest, first, many)
    out[term[often]] += c.T @ by_row
    out[term[~often]] += run_sums(by_row, number[order], start[~often], count[~often])


def summed(numbers: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over all passages, with A their weighted term counts. Each task's sum travels
    as blocks of rows; the blocks of SUMS tasks are added, then those sums, one at a time."""
    shared = numbers.sparkSession.sparkContext.broadcast((weight[:, None] * basis).astype(np.float32))
    shape = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.float64)
        for batch in batches:
            for blob, sizes in zip(*batch.columns, strict=True):
                ids = np.frombuffer(blob.as_py(), kind(shape[0]))
                size = np.frombuffer(sizes.as_py(), np.uint8).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(size)])
                for at in range(0, len(size), SUMMED):
                    part = size[at : at + SUMMED]
                    add_products(out, shared.value, ids[edge[at] : edge[at + len(part)]], np.repeat(np.arange(len(part)), part), len(part))
        group = TaskContext.get().partitionId() // SUMS
        blocks = np.array_split(np.arange(shape[0]), blocks_n)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks_n), pa.int32()), pa.array([group] * blocks_n, pa.int32()), pa.array([out[b].tobytes() for b in blocks], pa.binary())], names=["block", "group", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, group, cells in zip(*batch.columns, strict=True):
                part = np.frombuffer(cells.as_buffer(), np.float64)
                key = block.as_py(), group.as_py()
                if key in total:
                    total[key] += part
                else:
                    total[key] = part.copy()
        for (block, group), cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "group", "cells"])

    blocks_n = max(1, shape[0] // 1024)
    kinds = "block int, group int, cells binary"
    parts = common.map_arrow(numbers.filter("ids is not null").select("ids", "sizes"), run, kinds)
    groups = max(1, numbers.rdd.getNumPartitions() // SUMS)
    if groups > 1:
        parts = common.map_arrow(parts.repartition(blocks_n * groups, "block", "group"), add, kinds)
    rows = common.map_arrow(parts.withColumn("group", F.lit(0)).repartition(blocks_n, "block"), add, kinds).collect()
    whole: dict[int, np.ndarray] = {}
    for r in rows:
        whole[r.block] = whole.get(r.block, 0) + np.frombuffer(r.cells, np.float64)
    return np.concatenate([whole[k] for k in sorted(whole)]).reshape(shape) * weight[:, None] if whole else np.zeros(shape)


class Passages:
    """The benchmark's passages: term counts, as sorted entries (row, term, count)."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.owner: list[int] = []
        rows, ids = [], []
        for k, item in enumerate(items):
            for at in range(0, len(item), PASSAGE):
                part = item[at : at + PASSAGE]
                if at and len(part) < PASSAGE // 2:
                    part = item[-PASSAGE:]
                rows.append(np.full(len(part), len(self.owner), np.int64))
                ids.append(part.astype(np.int64))
                self.owner.append(k)
        both, count = np.unique(np.stack([np.concatenate(rows), np.concatenate(ids)]), axis=1, return_counts=True)
        self.row, self.term, self.count = both[0], both[1], count.astype(np.float64)

    def times(self, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weighted counts x ``cells``, by passage."""
        out = np.zeros((len(self.owner), cells.shape[1]))
        value = self.count * weight[self.term]
        for at in range(0, len(self.row), 1 << 16):
            cut = slice(at, at + (1 << 16))
            np.add.at(out, self.row[cut], value[cut, None] * cells[self.term[cut]])
        return out

    def back(self, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Transposed weighted counts x ``cells``, by term."""
        out = np.zeros((len(weight), cells.shape[1]))
        value = self.count * weight[self.term]
        for at in range(0, len(self.row), 1 << 16):
            cut = slice(at, at + (1 << 16))
            np.add.at(out, self.term[cut], value[cut, None] * cells[self.row[cut]])
        return out


def fit(documents: DataFrame, benchmark: DataFrame, seed: int = 41) -> Model | None:
    """The model of a benchmark, whose items the driver holds, for ``documents``."""
    rows = benchmark.select("item_id", "text").dropna().orderBy("item_id", "text").collect()
    items = [i for i in (made_item(r.item_id, r.text) for r in rows) if i.words]
    if not items:
        return None
    terms = sorted({w for i in items for w in i.words})
    numbers = numbered(documents, terms)
    df, passages = counted(numbers, len(terms))
    place = {w: i for i, w in enumerate(terms)}
    weight = np.log((passages + 1) / (df + 1)) + 0.05
    own = Passages([np.array([place[w] for w in i.words], np.int32) for i in items])
    rng = np.random.default_rng(seed)
    k = min(RANK + OVER, len(terms))
    omega = rng.standard_normal((len(terms), k))
    # the benchmark's own passages weigh as much in all as the documents'
    y = summed(numbers, weight, omega) + own.back(own.times(omega, weight), weight) * max(1.0, passages / len(own.owner))
    # A'A is about Y (W'Y)^-1 Y', of which the leading eigenvectors are taken
    q, r = np.linalg.qr(y)
    core = omega.T @ y
    vals, vecs = np.linalg.eigh(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-10, hermitian=True) @ r.T)
    basis = q @ vecs[:, np.argsort(-vals)[:RANK]]
    return model_of(items, place, weight, basis, own)


def model_of(items: list[Item], place: dict[bytes, int], weight: np.ndarray, basis: np.ndarray, own: Passages) -> Model:
    found = own.times(basis, weight).astype(np.float32)
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    mass = own.times(np.ones((len(weight), 1)), weight)[:, 0]
    owner = np.array(own.owner)
    targets, anchors = [], {}
    width = np.zeros(len(items), int)
    for i, item in enumerate(items):
        ids = np.array([place[w] for w in item.words], np.int32)
        n = len(ids)
        width[i] = next((w for w in WINDOWS if min(n, PASSAGE) <= w), WINDOWS[-1])
        lap = int(width[i]) // 4
        answer = [place[w] for w in item.answer]
        at = int(np.argmax(weight[ids]))
        anchors.setdefault(int(ids[at]), []).append((i, at))
        targets.append(Target(item.item_id, ids, bit_masks(ids.tolist()), len(answer), bit_masks(answer), lap, n // 2 + lap, n + n // 2 + 2 * lap))
    kinds = []
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width[owner] == w)
        kinds.append((w, found[mine], owner[mine], float(mass[mine].min())))
    flags = np.zeros(len(place) + 1, bool)
    flags[list(anchors)] = True
    vectors = np.vstack([weight[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    return Model(place, np.append(weight, 0).astype(np.float32), vectors, targets, kinds, anchors, flags)


def verbatim(ids: np.ndarray, model: Model) -> dict[int, int]:
    """By number of target, the first word of its first occurrence as a whole, if any."""
    hits = np.flatnonzero(model.anchor[ids])
    out: dict[int, int] = {}
    for term in np.unique(ids[hits]).tolist():
        places = hits[ids[hits] == term]
        for k, at in model.anchors[term]:
            item = model.targets[k].ids
            start = places - at
            start = start[(start >= 0) & (start + len(item) <= len(ids))]
            for i, t in enumerate(item):
                if not len(start):
                    break
                start = start[ids[start + i] == t]
            if len(start):
                out[k] = int(start[0])
    return out


def candidates(docs: list[np.ndarray], model: Model) -> np.ndarray:
    """Rows (document, target, start, cosine) of the windows that may hold a target, in order."""
    sizes = np.array([len(d) for d in docs], np.int64)
    found = [np.zeros((0, 4))]
    laps = [width // 4 for width, *_ in model.kinds]
    short, long = min(laps), max(laps)
    # each document is filled up to whole steps, and three more
    steps = -(-sizes // long) + 3
    begin = (np.cumsum(steps) - steps) * long
    flat = np.full(int(steps.sum()) * long, -1, np.int32)
    for d, at in zip(docs, begin.tolist(), strict=True):
        flat[at : at + len(d)] = d
    weighed = model.weight[flat].reshape(-1, short).sum(axis=1)
    windows = []
    for lap, (width, _, _, least) in zip(laps, model.kinds, strict=True):
        many = np.where(sizes > 0, -(-np.maximum(sizes - width // 2, 1) // lap), 0)
        doc = np.repeat(np.arange(len(docs)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        window = begin[doc] // lap + number
        mass = weighed.reshape(-1, lap // short).sum(axis=1)
        full = (mass[:-3] + mass[1:-2] + mass[2:-1] + mass[3:])[window] >= MASS * least
        windows.append((doc[full], number[full], window[full]))
    step = GROUP // long
    for at in range(0, int(steps.sum()), step):
        some = [np.searchsorted(window, (at * (long // lap), (at + step) * (long // lap))) for lap, (_, _, window) in zip(laps, windows, strict=True)]
        if all(a == b for a, b in some):
            continue
        part = flat[at * long : (at + step + 3) * long].reshape(-1, short)
        blocks = model.vectors[part[:, 0]]
        for j in range(1, short):
            blocks += model.vectors[part[:, j]]
        for lap, (_, passages, owner, _), (doc, number, window), (a, b) in zip(laps, model.kinds, windows, some, strict=True):
            if a == b:
                continue
            block = blocks if lap == short else blocks.reshape(-1, lap // short, blocks.shape[1]).sum(axis=1)
            two = block[:-1] + block[1:]
            x = (two[:-2] + two[2:])[window[a:b] - at * (long // lap)]
            like = x @ passages.T
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-6))
            w, p = np.divmod(np.flatnonzero(like >= np.float32(COSINE) * norm[:, None]), len(owner))
            found.append(np.stack([doc[a:b][w], owner[p], number[a:b][w] * lap, like[w, p] / norm[w]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((-rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a window may be like several passages of an item
    rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])[: len(rows)]]
    # one check serves two windows that follow each other
    lap = np.array([t.lap for t in model.targets])[rows[:, 1].astype(int)]
    alone = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] - rows[:-1, 2] != lap[1:])])[: len(rows)]
    place = np.arange(len(rows))
    return rows[(place - np.maximum.accumulate(np.where(alone, place, 0))) % 2 == 0] if len(rows) else rows


def covers(ids: np.ndarray, target: np.ndarray, first: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """Longest common subsequences of targets of at most 64 words and the words from ``first`` to
    ``end`` of ``ids``: the bit vectors of many pairs at once."""
    out = np.zeros(len(target), np.int64)
    padded = np.append(ids, -1)
    for at in range(0, len(target), CHECKED):
        part = slice(at, at + CHECKED)
        some, row = np.unique(target[part], return_inverse=True)
        masks = np.zeros((len(some), len(model.place) + 1), np.uint64)
        for k, t in enumerate(some.tolist()):
            for term, bits in model.targets[t].masks.items():
                masks[k, term] = bits
        n = np.array([len(model.targets[t].ids) for t in some.tolist()])[row]
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - n).astype(np.uint64)
        v = full.copy()
        place, stop = first[part].copy(), end[part]
        for _ in range(int((stop - place).max())):
            m = masks[row, padded[np.where(place < stop, place, len(ids))]]
            u = v & m
            v = ((v + u) | (v - u)) & full
            place += 1
        out[part] = n - np.bitwise_count(v)
    return out


Held = tuple[float, float, float, int]


def better(a: Held, b: Held | None) -> Held:
    """The one with more cover, then the first one."""
    return a if b is None or (*a[:3], -a[3]) > (*b[:3], -b[3]) else b


def found_in(docs: list[np.ndarray], model: Model) -> list[dict[int, Held]]:
    """For each document, by item_id: (cover, answer's cover, cosine, first word) of the items it holds."""
    out: list[dict[int, Held]] = [{} for _ in docs]
    whole = [verbatim(d, model) for d in docs]
    for held, items in zip(out, whole, strict=True):
        for k, start in items.items():
            item = model.targets[k].item_id
            held[item] = better((1.0, 1.0, 1.0, start), held.get(item))
    rows = candidates(docs, model)
    doc, target, start = rows[:, :3].astype(np.int64).T
    sizes = np.array([len(d) for d in docs], np.int64)
    offset = np.cumsum(sizes) - sizes
    shape = np.array([(t.before, t.after, len(t.ids)) for t in model.targets])[target]
    first, end = np.maximum(start - shape[:, 0], 0), np.minimum(start + shape[:, 1], sizes[doc])
    order = np.argsort(target, kind="stable")
    short = order[shape[order, 2] <= 64]
    cover = np.full(len(rows), -1)
    cover[short] = covers(np.concatenate([*docs, np.zeros(0, np.int32)]), target[short], (offset[doc] + first)[short], (offset[doc] + end)[short], model)
    for i in np.flatnonzero((cover < 0) | (cover >= CLOSE * shape[:, 2])).tolist():
        d, t = int(doc[i]), model.targets[k := int(target[i])]
        if k in whole[d]:
            continue
        n = len(t.ids)
        region = docs[d][first[i] : end[i]].tolist()
        own = int(cover[i]) if cover[i] >= 0 else common_length(t.masks, n, region)
        if own < CLOSE * n:
            continue
        answer = common_length(t.answer_masks, t.answer, region) / t.answer
        if own >= EXACT * n or answer >= CLOSE:
            # the sequence starts at the last word without which it is shorter
            low, high = 0, len(region) - 1
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if common_length(t.masks, n, region[mid:]) == own else (low, mid - 1)
            out[d][t.item_id] = better((own / n, answer, float(rows[i, 3]), int(first[i]) + low), out[d].get(t.item_id))
    return out


FOUND = "item_id bigint, cover double, answer_cover double, cosine double, word bigint"


def searched(texts: Iterator[str | None], model: Model) -> Iterator[dict[int, Held]]:
    """What each text holds, in order; texts are searched together up to GROUP words."""
    held: list[np.ndarray] = []
    words = 0
    for own in numbers_of(texts, list(model.place)):
        held.append(own)
        words += len(own)
        if words >= GROUP:
            yield from found_in(held, model)
            held, words = [], 0
    yield from found_in(held, model)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cover, answer_cover, cosine, word) of every document that holds an item."""
    model = fit(documents, benchmark)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches):
            out = []
            if shared.value is not None:
                texts = (t.as_py() for t in batch.column(1))
                for doc_id, held in zip(batch.column(0), searched(texts, shared.value), strict=True):
                    out += [(doc_id.as_py(), k, *v) for k, v in sorted(held.items())]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "cover", "answer_cover", "cosine", "word"])

    return common.map_arrow(documents.select("doc_id", "text"), run, f"doc_id bigint, {FOUND}")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, all columns as they were."""
    model = fit(documents, benchmark)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = documents.schema.fields
    at_text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches):
            texts = (t.as_py() for t in batch.column(at_text))
            keep = [True] * batch.num_rows if shared.value is None else [not held for held in searched(texts, shared.value)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(documents, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
