from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from mathloom.llm import mixing, sharding, sql
from tests.llm.fixtures import documents, odd, widened

# ---- mixing


def pour(caps, weights, given):
    """Fills children by weight until full; whole numbers, as the operator has it."""
    got, open_, left = dict.fromkeys(caps, 0), dict(caps), given
    while open_:
        total = sum(weights[c] for c in open_)
        full = [c for c in open_ if open_[c] * total <= left * weights[c]]
        if not full:
            for c in open_:
                got[c] = left * weights[c] // total
            break
        best = min(full, key=lambda c: (open_[c] / weights[c], c))
        got[best] = open_.pop(best)
        left -= got[best]
    return got


def brute_mixture(rows):
    def weight(level, name):
        return mixing.WEIGHTS[level].get(name, 1)

    def tokens(t):
        return len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])

    leaf, docs = defaultdict(int), defaultdict(list)
    for i, t, lang, source in rows:
        k = ("d" + "0123012301230123"["0123456789abcdef".index(hashlib.md5((source or "").encode()).hexdigest()[0])], lang or "und", source or "")
        leaf[k] += tokens(t)
        docs[k].append((i, tokens(t)))
    caps = {k: v * mixing.EPOCHS for k, v in leaf.items()}

    def give(prefix, given):
        n = len(prefix)
        if n == 3:
            return {prefix: given}
        names = sorted({k[n] for k in caps if k[:n] == prefix})
        own = {c: sum(v for k, v in caps.items() if k[: n + 1] == (*prefix, c)) for c in names}
        out = {}
        for c, b in pour(own, {c: weight(mixing.TREE[n], c) for c in names}, given).items():
            out |= give((*prefix, c), b)
        return out

    out = Counter()
    for k, b in give((), sum(leaf.values()) * mixing.SHARE[0] // mixing.SHARE[1]).items():
        whole = b // leaf[k] if leaf[k] else 0
        rest, run = b - whole * leaf[k], 0
        ranked = defaultdict(list)
        for i, n in docs[k]:
            ranked[hashlib.md5(f"{mixing.SEED}:{whole}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        for _, same in sorted(ranked.items()):
            run += sum(n for _, n in same)
            for i, n in same:
                c = whole + (rest > 0 and run <= rest)
                if c:
                    out[(i, *k, n, c, b)] += 1
    return out


@pytest.fixture(scope="module")
def some(spark, sf):
    return odd(spark, sf, [(40_000 + i, "many words in one leaf " * (i % 7), "en", "src0") for i in range(300)])


def test_mixture_against_brute_force(spark, some):
    df = widened(documents(spark, some)).repartition(5)
    assert Counter(tuple(r) for r in mixing.mixture(df).collect()) == brute_mixture(some)


def test_mixture_against_sql(spark, some):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", some)
    want = Counter(con.sql("select doc_id, domain, language, origin, tokens, copies, leaf_budget from (" + sql.oracle_sql()["op6_mixing"] + ")").fetchall())
    assert Counter(tuple(r) for r in mixing.mixture(documents(spark, some)).collect()) == want


def test_shortage_goes_to_siblings_first():
    # the short child's share goes to its siblings by weight
    assert pour({"a": 10, "b": 1000, "c": 1000}, {"a": 2, "b": 1, "c": 1}, 100) == {"a": 10, "b": 45, "c": 45}


def test_shortage_rises_only_with_the_whole_subtree(spark):
    weights = {"domain": {}, "language": {}, "origin": {}}
    rows = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 100), ("d1", "en", "c", 100)], "domain string, language string, origin string, tokens bigint")
    got = {r.origin: r.budget for r in mixing.budgets(rows, 60, weights, 1).collect()}
    assert got == {"a": 10, "b": 20, "c": 30}
    got = {r.origin: r.budget for r in mixing.budgets(rows, 200, weights, 1).collect()}
    assert got == {"a": 10, "b": 90, "c": 100}


def test_mixed_rows(spark, some):
    df = widened(documents(spark, some))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = Counter()
    for (i, *_, c, _), n in brute_mixture(some).items():
        want[i] += c * n
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want


def test_nothing_to_mix(spark):
    assert mixing.mixture(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [(1, "", None, None)])).collect() == []


# ---- sharding


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        need, run = 1, 0
        for s in sizes:
            if run + s > mid:
                need, run = need + 1, 0
            run += s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_against_brute_force(spark, sf, shards, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = odd(spark, sf, [(50_000 + i, "the same text in a third of all rows", "en", "s") for i in range(120)])
    got = sharding.sharded(widened(documents(spark, rows)).repartition(5), shards).collect()
    assert len(got) == len(rows)
    group, where = defaultdict(int), defaultdict(set)
    for r, size in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.text_crc32)), [1] * len(got), strict=True):
        group[r.text_crc32] += r.size * size
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together
    texts = defaultdict(int)
    for _, t, *_ in rows:
        texts[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) == smallest_capacity([s for _, s in sorted(texts.items())], shards)
    assert set(load) <= set(range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows if i is not None and i > 9000}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got if r.doc_id in crc)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_few_rows(spark):
    assert sharding.sharded(documents(spark, [])).collect() == []
    (one,) = sharding.sharded(documents(spark, [(1, None, None, None)])).collect()
    assert (one.size, one.text_crc32, one.shard, one.slot) == (1, 0, 0, 0)


def test_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = [(7, "copied", "en", "s")] * 300 + [(7, "copied", "de", "t")] * 25 + [(i, f"text {i}", "en", "s") for i in range(100)]
    got = sharding.sharded(documents(spark, rows).repartition(4), 3, keep=("lang", "source")).collect()
    assert Counter((r.doc_id, r.lang, r.source) for r in got) == Counter((i, lang, s) for i, _, lang, s in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("few", [0, 20_000])
def test_mixture_by_either_join(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", few)
    rows = [(i % 40, f"word {'more ' * (i % 9)}", ("en", "de", None)[i % 3], f"src{i % 5}") for i in range(200)] + [(9, "hot row " * 3, "en", "src0")] * 120
    assert Counter(tuple(r) for r in mixing.mixture(documents(spark, rows)).collect()) == brute_mixture(rows)
