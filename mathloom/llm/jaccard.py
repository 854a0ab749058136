"""N-gram Jaccard join: all pairs of documents whose 2-word shingle sets overlap by 60 %.

Rare-first prefix filtering. Two sets with Jaccard t share a shingle among the first
``n - ceil(t n) + 1`` of each, in any order that all documents share; with rare shingles first
few documents meet there. The steps:

1. ``hot``: shingles that many documents share, of a bounded sample of documents. They stand
   last in the order, by hash, and their document lists are never gathered. (Only the order
   depends on the sample; any order gives the same links.)
2. Every text's set is hashed. Each chunk of documents sends its other shingles, as packed
   arrays, to the owners of hash ranges; an owner counts in how many documents each occurs,
   and answers the chunk with those that occur more than once. Shingles of one document only
   need no answer: they come first in the order and meet nobody.
3. A chunk then knows its documents' prefixes. Documents with equal sets become one class with
   a count. The classes' prefix entries (shingle, class, size, position) meet on the shingle,
   and the shingles' lists at their smallest class, as similar documents meet in many shingles;
   length and positional filters leave few pairs, each kept once.
4. Candidates are compared in blocks: classes are gathered around their smallest neighbour,
   clusters are cut into parts of bounded size, and a block holds two parts, so a class travels
   to as many blocks as its partners fill, not to each partner. Small blocks are put together,
   as each costs a call. First only bitmaps of the sets
   travel, and pairs go whose common bits, which bound the overlap, are too few. Then the texts
   of the others travel, and a block compares them exactly. Bounds are computed for all
   pairs of a block together.
5. Links give each class its number of linked documents; components come from alternating
   smallest-neighbour rounds on a spanning forest of each block.

Words are maximal runs of bytes other than space and \\t to \\r, A-Z lower-cased; a text with one
word has one shingle. Defined results: null and empty texts and texts without words have 0
shingles, no link and their own doc_id as component; documents with equal sets are linked;
repeated rows count as documents of their own; a null doc_id counts as a document and never
is a component's id unless it is alone. 64-bit hashes stand for shingles and 128-bit hashes
for whole sets. The documents are read several times and must be the same each time (a table, or
a checkpoint); every row is told once, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mathloom.llm import common
from mathloom.llm.common import settled

#: The link condition is 100 * intersection >= PERCENT * union.
PERCENT = 60
#: Documents in the sample for the hot shingles, about, and the number of them that makes one hot.
SAMPLE, HOT = 16_000, 16
#: Shingles of a chunk, of an owner and of a part of a cluster, about.
CHUNK, PART = 1 << 19, 200_000
#: Bytes of text whose shingles one owner counts, about; more owners for more text.
OWNER_BYTES = 6 << 20
#: Up to so many classes with candidates, their doc_ids are broadcast to find their texts.
BROADCAST_CLASSES = 500_000
#: Up to so many rows of 16 bytes that go are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Entries of a shingle's list that are handled at once; longer lists are cut.
WIDE = 512
#: Owners see this many bits of a shingle; the rest of the order is who owns it.
LOW = np.uint64((1 << 40) - 1)


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's 2-word shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    if len(w) == 1:
        return w
    with np.errstate(over="ignore"):
        h = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + (w[1:] ^ (w[1:] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix(n: np.ndarray | int) -> np.ndarray | int:
    """Length of the prefix of a set of ``n``: n - ceil(t n) + 1."""
    return n + (-PERCENT * n) // 100 + 1


def pack(values: np.ndarray, idx: np.ndarray) -> bytes:
    """Sorted 40-bit values and their 16-bit indexes, as planes of the differences' bytes."""
    diff = np.diff(values, prepend=np.zeros(1, np.uint64))
    return diff.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes() + idx.astype("<u2").tobytes()


def unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    diff = np.zeros((n, 8), np.uint8)
    diff[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(5, n).T
    return np.cumsum(diff.view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(blob, "<u2", n, 5 * n)


def hot_shingles(documents: DataFrame, total: int) -> np.ndarray:
    """Shingles in HOT or more documents of a sample of about SAMPLE: at most
    SAMPLE / HOT times the mean set size."""
    share = min(1.0, SAMPLE / max(total, 1))
    some = documents.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t.as_py() or b"") for t in batch.column(0).slice(at, 512)]
                h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    rows = common.map_arrow(some.select(F.col("text").cast("binary").alias("text")), counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)
    got = rows.select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


class Hot:
    """Membership in a sorted array, with a bit map before the binary search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(values >> np.uint64(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        if len(self.values) and out.any():
            some = h[out]
            at = np.minimum(np.searchsorted(self.values, some), len(self.values) - 1)
            out[out] = self.values[at] == some
        return out


SENT = "chunk bigint, owner int, n int, blob binary"


def sent(documents: DataFrame, hot: np.ndarray, owners: int) -> DataFrame:
    """Chunks' shingles by owner (owner >= 0), and one row (owner -1) with the chunk's documents."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)

    def one(docs: list[tuple], place: Hot, at: str) -> Iterator[tuple]:
        # a document: (doc_id, text_hash, set); at: partition and number of the chunk, so that
        # chunks of equal rows stay apart
        head, values, idx = [], [], []
        for i, (doc_id, text_hash, h) in enumerate(docs):
            common = place.of(h)
            late, rest = h[common], h[~common]
            n = len(h)
            need = int(prefix(n)) if n else 0
            # hot shingles are wanted only where the others don't fill the prefix
            late = np.sort(late & LOW)[: max(0, need - len(rest))]
            head.append((doc_id, text_hash, n, len(rest), xxhash.xxh3_128_digest(h.tobytes()), late.tobytes()))
            values.append(rest)
            idx.append(np.full(len(rest), i, np.uint16))
        chunk = xxhash.xxh3_64_intdigest(at.encode() + b"".join(h[4] + f"{h[0]},{h[1]}".encode() for h in head)) >> 1
        ids = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*head, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "text_hash", "n", "known", "sig", "late"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_batch(ids)
        yield chunk, -1, len(docs), sink.getvalue().to_pybytes()
        h = np.concatenate(values)
        i = np.concatenate(idx)
        order = np.argsort(h, kind="stable")
        h, i = h[order], i[order]
        owner = ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        edge = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        for o in range(owners):
            a, b = edge[o], edge[o + 1]
            if b > a:
                low = h[a:b] & LOW
                again = np.argsort(low, kind="stable")
                yield chunk, o, int(b - a), pack(low[again], i[a:b][again])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        c, o, n, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(o, pa.int32()), pa.array(n, pa.int32()), pa.array(b, pa.binary())], names=["chunk", "owner", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Hot(shared.value)
        partition = TaskContext.get().partitionId()
        docs: list[tuple] = []
        held = chunks = 0
        for batch in batches:
            for doc_id, text_hash, text in zip(*batch.columns, strict=True):
                h = shingles(text.as_py() or b"")
                docs.append((doc_id.as_py(), text_hash.as_py(), h))
                held += len(h) + 1
                if held > CHUNK or len(docs) == 1 << 16:
                    yield rows(list(one(docs, place, f"{partition},{chunks};")))
                    docs, held, chunks = [], 0, chunks + 1
        if docs:
            yield rows(list(one(docs, place, f"{partition},{chunks};")))

    return common.map_arrow(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")), run, SENT)


def answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's answer to each chunk: its shingles that occur in more than one document,
    with those documents' numbers in the chunk and the number of documents (255 for more)."""
    if pdf["owner"].iloc[0] < 0:
        return pdf[["chunk", "owner", "blob"]]
    parts = [unpack(b, len(b) // 7) for b in pdf["blob"]]
    sizes = [len(v) for v, _ in parts]
    values = np.concatenate([v for v, _ in parts])
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    df = np.empty(len(values), np.int64)
    df[order] = np.repeat(counts, counts)
    out, at = [], 0
    for (v, i), size in zip(parts, sizes, strict=True):
        own = df[at : at + size]
        at += size
        kept = own > 1
        out.append(pack(v[kept], i[kept]) + np.minimum(own[kept], 255).astype(np.uint8).tobytes())
    del parts, values, order, ordered, df
    common.give_back()
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "owner": pdf["owner"].to_numpy(), "blob": out})


PREFIXES = "doc_id bigint, text_hash bigint, n bigint, alone bigint, sig binary, entries binary"


def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's documents with the entries of their prefixes that may meet others: 40-bit
    shingles, packed. Their positions follow each other, from ``alone`` on."""
    head = pa.ipc.open_stream(pdf.loc[pdf["owner"] < 0, "blob"].iloc[0]).read_all().to_pydict()
    blobs = pdf.loc[pdf["owner"] >= 0, "blob"].to_list()
    parts = [unpack(b, len(b) // 8) for b in blobs]
    v = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    i = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint16)]).astype(np.int64)
    df = np.concatenate([np.frombuffer(b, np.uint8, len(b) // 8, len(b) // 8 * 7) for b in blobs] or [np.zeros(0, np.uint8)])
    order = np.lexsort((v, df, i))
    v, i = v[order], i[order]
    edge = np.searchsorted(i, np.arange(len(head["n"]) + 1))
    out, first = [], []
    for k, (n, known, late) in enumerate(zip(head["n"], head["known"], head["late"], strict=True)):
        if not n:
            out.append(b"")
            first.append(0)
            continue
        own = v[edge[k] : edge[k + 1]]
        alone = known - len(own)
        need = int(prefix(n))
        use = np.concatenate([own, np.frombuffer(late, np.uint64)])[: max(0, need - alone)]
        out.append(np.ascontiguousarray(use).view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
        first.append(alone)
    return pd.DataFrame({"doc_id": pd.array(head["doc_id"], "Int64"), "text_hash": head["text_hash"], "n": head["n"], "alone": first, "sig": head["sig"], "entries": out})


def entries(classes: DataFrame) -> DataFrame:
    """(shingle, node, n, pos) of the classes' packed prefixes."""

    def shingle_of(blob: bytes) -> np.ndarray:
        wide = np.zeros((len(blob) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
        return wide.view(np.int64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                blobs = batch.column("entries").to_pylist()
                sizes = np.array([len(b) // 5 for b in blobs], np.int64)
                h = np.concatenate([shingle_of(b) for b in blobs] or [np.zeros(0, np.int64)])
                p = np.concatenate([np.arange(a, a + n) for a, n in zip(batch.column("alone").to_pylist(), sizes, strict=True)] or [np.zeros(0, np.int64)])
                which = pa.array(np.repeat(np.arange(len(blobs)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("node").take(which), batch.column("n").take(which), pa.array(p.astype(np.int32))], names=["shingle", "node", "n", "pos"])

    return common.map_arrow(classes.select("node", F.col("n").cast("int").alias("n"), "alone", "entries"), run, "shingle bigint, node bigint, n int, pos int")


LISTS = "least bigint, cut int, met binary"
ENTRY = np.dtype([("node", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def packed(own: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """Rows of LISTS: ``own`` has the lists' entries one after another."""
    ends = np.append(0, np.cumsum(sizes))
    blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(own.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(own["node"][ends[:-1]]), pa.array(cut, pa.int32()), blobs], names=["least", "cut", "met"])


def lists(h: np.ndarray, own: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """The entries of each shingle as a list by node. Lists of one are left out; longer ones than
    ``wide`` are cut into parts, and each part and each two parts (``cut``: where the second
    begins) make a list, so that all their pairs still meet."""
    order = np.lexsort((own["node"], h))
    h, own = h[order], own[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(starts, len(h)))
    fits = (sizes > 1) & (sizes <= wide)
    if fits.any():
        yield packed(own[np.repeat(fits, sizes)], sizes[fits], np.zeros(fits.sum(), np.int32))
    for at in np.flatnonzero(sizes > wide):
        whole = own[starts[at] : starts[at] + sizes[at]]
        cells = [whole[k : k + wide // 2] for k in range(0, len(whole), wide // 2)]
        for i, one in enumerate(cells):
            yield packed(one, np.array([len(one)]), np.zeros(1, np.int32))
            for other in cells[i + 1 :]:
                yield packed(np.concatenate([one, other]), np.array([len(one) + len(other)]), np.array([len(one)]))


def fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of entries pass the length and positional filters, with the smaller node first."""
    na, nb = x["n"].astype(np.int64), y["n"].astype(np.int64)
    need = (PERCENT * (na + nb) + 99 + PERCENT) // (100 + PERCENT)  # ceil(t / (1 + t) * (na + nb))
    return (x["node"] < y["node"]) & (na * 100 >= PERCENT * nb) & (nb * 100 >= PERCENT * na) & (na - x["pos"] >= need) & (nb - y["pos"] >= need)


def alike(own: np.ndarray) -> np.ndarray:
    """Rows of a matrix of entries, one for each list of nodes, with the nodes' least positions
    (which let through what any of the rows lets through, and perhaps more)."""
    order = np.lexsort(own["node"].T)
    own = own[order]
    first = np.flatnonzero(np.append(True, (own["node"][1:] != own["node"][:-1]).any(axis=1)))
    out = own[first]
    out["pos"] = np.minimum.reduceat(own["pos"], first, axis=0)
    return out


#: Pairs that are made at once.
BLOCK = 1 << 20


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of the lists' entries that pass the filters, each once in a block."""

    def told(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    for batch in batches:
        blobs, cuts = batch.column("met").to_pylist(), batch.column("cut").to_numpy()
        sizes = np.array([len(x) // ENTRY.itemsize for x in blobs])
        own = np.frombuffer(b"".join(blobs), ENTRY)
        starts = np.cumsum(sizes) - sizes
        found, held = [], 0
        for size, cut in sorted(set(zip(sizes.tolist(), cuts.tolist(), strict=True))):
            rows = alike(own[starts[(sizes == size) & (cuts == cut)][:, None] + np.arange(size)])
            i, j = np.triu_indices(size, 1)
            if cut:
                across = (i < cut) & (j >= cut)
                i, j = i[across], j[across]
            step = max(1, BLOCK // max(len(i), 1))
            for at in range(0, len(rows), step):
                x, y = rows[at : at + step, i].ravel(), rows[at : at + step, j].ravel()
                ok = fitting(x, y)
                found.append((x["node"][ok], y["node"][ok]))
                held += int(ok.sum())
                if held > BLOCK:
                    yield told(found)
                    found, held = [], 0
        if found:
            yield told(found)


def meetings(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """Pairs (a, b) with a < b that pass the length and positional filters, some several times.

    Similar documents meet in many shingles. Their lists go on to their smallest node before
    pairs are made of them, so what is shuffled grows with the entries, and most repeats of a
    pair are met in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, more = np.zeros(0, np.int64), np.zeros(0, ENTRY)
        for batch in batches:
            h = np.concatenate([left, batch.column("shingle").to_numpy()])
            own = np.concatenate([more, np.zeros(batch.num_rows, ENTRY)])
            for name in ENTRY.names:
                own[name][len(left) :] = batch.column(name).to_numpy()
            if not len(h):
                continue
            # the last shingle may go on in the next batch
            last = int(np.searchsorted(h, h[-1]))
            left, more = h[last:], own[last:]
            if last:
                yield from lists(h[:last], own[:last], wide)
        if len(left):
            yield from lists(left, more, wide)

    gathered = common.map_arrow(found.repartition("shingle").sortWithinPartitions("shingle"), run, LISTS)
    return common.map_arrow(gathered.repartition("least").sortWithinPartitions("least"), paired, "a bigint, b bigint")


def candidates(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b that may hold."""
    return meetings(found).distinct()


def bitmap(h: np.ndarray) -> np.ndarray:
    """The low ends of a set's hashes as bits, of which there are 4 to 8 for each."""
    bits = np.zeros(1 << max(6, (4 * len(h) - 1).bit_length()), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def shared_bound(x: np.ndarray, y: np.ndarray, spare: int) -> int:
    """An upper bound of the overlap of two sets with the bitmaps ``x`` and ``y``, where ``y`` is no
    longer and ``spare`` hashes of its set found their bit taken: shared ones are at most the
    bits in both, and the spare ones."""
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] | x[half:]
    return int(np.bitwise_count(x & y).sum()) + spare


LINKS = "a bigint, b bigint, forest boolean, na bigint, nb bigint"


def places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in ``ids``, which are distinct, the wanted ones stand."""
    order = np.argsort(ids)
    return order[np.searchsorted(ids, wanted, sorter=order)]


def shared_bounds(maps: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``shared_bound`` of the pairs (i, j) of the bitmaps of sets of these sizes; pairs of bitmaps
    of like lengths together."""
    lengths = np.array([len(m) for m in maps], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(maps)
    spare = sizes - np.add.reduceat(np.bitwise_count(flat), starts, dtype=np.int64)
    short = lengths[i] < lengths[j]
    p, q = np.where(short, j, i), np.where(short, i, j)
    out = spare[q]
    for long, brief in sorted(set(zip(lengths[p].tolist(), lengths[q].tolist(), strict=True))):
        alike = np.flatnonzero((lengths[p] == long) & (lengths[q] == brief))
        step = max(1, BLOCK // long)
        for at in range(0, len(alike), step):
            rows = alike[at : at + step]
            x = flat[starts[p[rows]][:, None] + np.arange(long)].reshape(len(rows), long // brief, brief)
            x = np.bitwise_or.reduce(x, axis=1) & flat[starts[q[rows]][:, None] + np.arange(brief)]
            out[rows] += np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    return out


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The overlap that sets of these sizes need: ceil(t / (1 + t) * (na + nb))."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block: rows with b = -1 are classes with their text, the others are candidate pairs."""
    b = pdf["b"].to_numpy(np.int64)
    texts, pairs = pdf[b < 0], pdf[b >= 0]
    ids, weight = texts["a"].to_numpy(np.int64), texts["copies"].to_numpy(np.int64)
    a, b = pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64)
    i, j = places(ids, a), places(ids, b)
    sets = [shingles(bytes(t)) for t in texts["text"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    need = needed(sizes[i], sizes[j])
    maps = [bitmap(s) for s in sets]
    holds = shared_bounds(maps, sizes, i, j) >= need
    for k in np.flatnonzero(holds).tolist():
        x, y = sets[i[k]], sets[j[k]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        holds[k] = np.count_nonzero(y[at] == x) >= need[k]
    a, b, i, j = a[holds], b[holds], i[holds], j[holds]
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        r, s = top(x), top(y)
        root[r] = s
        forest[k] = r != s
    del sets, maps, texts, pairs, pdf
    common.give_back()
    return pd.DataFrame({"a": a, "b": b, "forest": forest, "na": weight[i], "nb": weight[j]})


def gathered(classes: DataFrame, pairs: DataFrame, carried: DataFrame) -> DataFrame:
    """The blocks' rows: pairs (a, b), and with b = -1 the classes that a block needs, with the two
    columns that ``carried`` has beside node. Most pairs of chance would be a block of their own,
    so blocks are put together, by hash, until they hold about two parts."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    near = ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")).join(classes.select("node", "n"), "node")
    sizes = near.groupBy("label").agg(F.sum("n").alias("all"))
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("all") / PART))).cast("int")
    placed = settled(near.join(sizes, "label").select("node", "n", F.struct("label", part.alias("part")).alias("cell")))
    of = lambda e: placed.select(F.col("node").alias(e), F.col("cell").alias(f"c{e}"), F.col("n").alias(f"n{e}"))
    cells = pairs.join(of("a"), "a").join(of("b"), "b")
    cells = settled(cells.select("a", "b", "na", "nb", F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("block")))
    held = cells.select(F.col("a").alias("node"), "block", F.col("na").alias("n")).unionAll(cells.select("b", "block", "nb")).distinct().agg(F.sum("n")).first()[0] or 0
    many = max(1, -(-held // (2 * PART)))
    cells = cells.select("a", "b", F.pmod("block", F.lit(many)).alias("block"))
    need = cells.select(F.col("a").alias("node"), "block").unionAll(cells.select("b", "block")).distinct()
    own = need.join(carried, "node")
    blob, number = (c for c in carried.columns if c != "node")
    rows = own.select("block", F.col("node").alias("a"), F.lit(-1).cast("bigint").alias("b"), blob, number).unionAll(cells.select("block", "a", "b", F.lit(None).cast("binary"), F.lit(0).cast("bigint")))
    # few bytes may be much work, so the number of tasks follows the blocks
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // 64)
    return rows.repartition(min(many, tasks), "block")


def screened(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a block that may hold by their bitmaps: rows with b = -1 are classes."""
    b = pdf["b"].to_numpy(np.int64)
    maps, pairs = pdf[b < 0], pdf[b >= 0]
    ids, sizes = maps["a"].to_numpy(np.int64), maps["n"].to_numpy(np.int64)
    bits = [np.frombuffer(m, np.uint64) for m in maps["map"]]
    i, j = places(ids, pairs["a"].to_numpy(np.int64)), places(ids, pairs["b"].to_numpy(np.int64))
    out = pairs.loc[shared_bounds(bits, sizes, i, j) >= needed(sizes[i], sizes[j]), ["a", "b"]].astype("int64")
    del maps, bits, pairs, pdf
    common.give_back()
    return out


def likely(classes: DataFrame, pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs that may hold by the bitmaps ``maps`` (node, map, n), so that the texts of others
    needn't travel."""
    return gathered(classes, pairs, maps).groupBy("block").applyInPandas(screened, "a bigint, b bigint")


def links(classes: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that hold, with the classes' numbers of documents; ``texts``: (node, text)."""
    carried = classes.select("node", "copies").join(texts, "node").select("node", "text", "copies")
    return gathered(classes, pairs, carried).groupBy("block").applyInPandas(verified, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node with.

    Large-star and small-star rounds: every node hands its larger neighbours, then itself and
    its smaller ones, to the smallest of them, until nothing changes.
    """
    edges = settled(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each row (a, b) now has b < a
        least = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", least)
        small = small.select("a", F.col("m").alias("b")).unionAll(small.filter("b > m").select(F.col("b"), F.col("m"))).distinct()
        edges = settled(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def joined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, text_hash, sig, n, n_similar, root and component_id
    of every row; links the pairs (a, b) of numbers of classes of different sets."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    hot = hot_shingles(docs, total)
    owners = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // OWNER_BYTES)
    out = sent(docs, hot, owners)
    answered = out.withColumn("to", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(-1 - F.pmod("chunk", F.lit(owners)).cast("int")))
    answered = answered.groupBy("to").applyInPandas(answers, "chunk bigint, owner int, blob binary")
    known = settled(answered.groupBy("chunk").applyInPandas(prefixes, PREFIXES))
    if (told := known.count()) != total:
        raise RuntimeError(f"{total} rows were read and {told} told; documents must be a table that is read alike each time")
    filled = known.filter("n > 0")
    classes = settled(filled.groupBy("sig").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.max("alone").alias("alone"), F.max("entries").alias("entries")))
    # numbers are by partition and row of the checkpoint, so they are the same whenever it is read
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    pairs = settled(candidates(entries(classes)))
    pairs = settled(likely(classes, pairs, class_maps(docs, classes, pairs)))
    texts = class_texts(docs, classes, pairs)
    found = settled(links(classes, pairs, texts))
    degree = found.select(F.col("a").alias("node"), F.col("nb").alias("n")).unionAll(found.select("b", "na")).groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(found.filter("forest"))
    group = classes.select("sig", "node", "copies", "least_id").join(roots, "node", "left").join(degree, "node", "left")
    group = group.withColumn("root", F.coalesce("root", "node"))
    first = group.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = group.join(first, "root").select("sig", "root", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), "component_id")
    return known.drop("entries", "alone").join(told, "sig", "left"), found


def with_candidates(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, sig, least_id) of the classes in pairs."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    return settled(classes.select("node", "sig", "least_id").join(wanted, "node", "left_semi"))


def class_maps(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, map, n): bitmap and size of the set of each class that has a candidate. No text is
    shuffled: rows are hashed where they are read, those of few classes after a filter by doc_id."""
    chosen = with_candidates(classes, pairs)
    if chosen.count() <= BROADCAST_CLASSES:
        ids = F.broadcast(chosen.select("least_id").distinct())
        docs = docs.join(ids, docs["doc_id"].eqNullSafe(ids["least_id"]), "left_semi")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [h for t in batch.column(0).slice(at, 512) if len(h := shingles(t.as_py() or b""))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([bitmap(h).tobytes() for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64())], names=["sig", "map", "n"])

    maps = common.map_arrow(docs.select(F.col("text").cast("binary").alias("text")), mapped, "sig binary, map binary, n bigint")
    return maps.join(chosen.select("node", "sig"), "sig").groupBy("node").agg(F.max("map").alias("map"), F.max("n").alias("n"))


def class_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text): one text of each class that has a candidate. Texts are found by doc_id and
    hashed again, as a doc_id may stand for several rows."""
    chosen = with_candidates(classes, pairs)
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CLASSES else chosen

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sigs = [xxhash.xxh3_128_digest(shingles(t.as_py() or b"").tobytes()) for t in part.column(2)]
                same = pa.array([s == k.as_py() for s, k in zip(sigs, part.column(1), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], names=["node", "text"]).filter(same)

    texts = docs.withColumn("text", F.col("text").cast("binary")).join(chosen, docs["doc_id"].eqNullSafe(chosen["least_id"])).select("node", "sig", "text")
    return common.map_arrow(texts, signed, "node bigint, text binary").groupBy("node").agg(F.max("text").alias("text"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every row."""
    members, _ = joined(documents)
    alone = F.col("n") == 0
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.lit(0)).otherwise(F.col("n_similar")).cast("bigint").alias("n_similar"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (then text hash), all
    columns as they were; rows without words are all kept."""
    members, _ = joined(documents)
    members = settled(members.filter("n > 0").select("doc_id", "text_hash", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = members.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_hash")
    rows = members.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = kept.withColumn("stays", F.lit(True))
    both = ["doc_id", "text_hash"]
    told = settled(rows.join(kept, [rows[c].eqNullSafe(kept[c]) for c in both], "left").select(*[rows[c].alias(f"{c}_") for c in both], "n", F.coalesce("stays", F.lit(False)).alias("stays")))
    out = documents.withColumn("row_", F.struct(*documents.columns)).select("row_", F.col("doc_id").cast("bigint").alias("id_"), F.xxhash64("text").alias("hash_"))

    def on(side: DataFrame) -> list:
        return [out["id_"].eqNullSafe(side["doc_id_"]), out["hash_"] == side["text_hash_"]]

    gone = told.filter("not stays").select("doc_id_", "text_hash_")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = out.join(gone, on(gone), "left_anti")
    # rows that are repeated as a whole, of which one stays
    again = told.filter("stays and n > 1").select("doc_id_", "text_hash_")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        single = out.join(again, on(again), "left_anti")
        first = out.join(again, on(again), "left_semi").groupBy("id_", "hash_").agg(F.first("row_").alias("row_"))
        out = single.select("row_").unionAll(first.select("row_"))
    return out.select("row_.*")
