from __future__ import annotations

import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathloom.llm import common, decontaminate, jaccard
from tests.llm.fixtures import documents, odd, widened


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", low)
    return frozenset([tuple(w)] if len(w) == 1 else zip(w, w[1:], strict=False))


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    near = [set() for _ in rows]
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                    near[i].add(j)
                    near[j].add(i)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i] if group[i] == i else []
        seen = set(todo)
        while todo:
            x = todo.pop()
            group[x] = i
            new = near[x] - seen
            seen |= new
            todo += new
    ids = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            ids[g] = min(ids.get(g, rows[i][0]), rows[i][0])
    return [(r[0], len(s), len(n), ids.get(g)) for r, s, n, g in zip(rows, sets, near, group, strict=True)], group


def family(seed=3):
    """Edited copies at every distance around the limit, chains, and small sets."""
    rnd = random.Random(seed)
    out = []
    words = [f"w{i}" for i in range(4000)]
    for f in range(6):
        text = [rnd.choice(words) for _ in range(60)]
        for k in range(18):
            edited = list(text)
            for _ in range(k):
                edited[rnd.randrange(60)] = rnd.choice(words)
            out.append((20_000 + 100 * f + k, " ".join(edited), "en", "s"))
            text = edited if f % 2 else text
    out += [(21_000 + i, " ".join("abcdefgh"[: i + 1]), "en", "s") for i in range(8)]
    out += [(21_100, "a b a b", "en", "s"), (21_101, "A  b\ta\nb", "en", "s"), (21_102, "É x", "en", "s"), (21_103, "é x", "en", "s")]
    return out


def test_all_links_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 2000)  # so that clusters are cut into parts
    monkeypatch.setattr(jaccard, "CHUNK", 20_000)
    rows = odd(spark, sf, family())
    df = widened(documents(spark, rows)).repartition(5)
    got = Counter(tuple(r) for r in jaccard.near_duplicates(df).collect())
    assert got == Counter(brute(rows)[0])


def test_one_of_each(spark, sf):
    rows = odd(spark, sf, family())
    df = widened(documents(spark, rows)).repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = kept.select("doc_id", "text").collect()
    want, group = brute(rows)
    wordless = sum(1 for w in want if w[1] == 0)
    assert len(got) == wordless + len({g for g, w in zip(group, want, strict=True) if w[1]})
    by_text = {}
    for (_, t, *_), g in zip(rows, group, strict=True):
        by_text[t] = g
    assert max(Counter(by_text[r.text] for r in got if shingle_set(r.text)).values()) == 1


def test_table_twice(spark, monkeypatch):
    rows = [*family()[:60], (None, "a b c", "en", "s"), (7, "", "en", "s")]
    df = documents(spark, rows).coalesce(1)
    both = df.union(df)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(both).collect()) == Counter(brute(rows + rows)[0])
    once, twice = (Counter(r.text for r in jaccard.one_of_each(d).collect()) for d in (df, both))
    assert twice == once + Counter([""])  # rows without words are all kept
    # chunks of one long row each, in one partition
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    rows = [(None, rows[0][1], "en", "s")] * 3 + rows[20:22]
    assert Counter(tuple(r) for r in jaccard.near_duplicates(documents(spark, rows).coalesce(1)).collect()) == Counter(brute(rows)[0])


def test_joins_without_broadcasts(spark, sf, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "OWNER_BYTES", 2000)
    rows = odd(spark, sf, family()[:60])
    df = documents(spark, rows).repartition(3)
    df = df.union(df)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == Counter(brute(rows + rows)[0])
    want, group = brute(rows + rows)
    kept = jaccard.one_of_each(df)
    assert kept.count() == sum(1 for w in want if w[1] == 0) + len({g for g, w in zip(group, want, strict=True) if w[1]})


def test_equal_rows_everywhere(spark):
    """One row many times over, in many partitions, with and without an id, and many rows of one id."""
    for rows in ([(5, "the very same row", "en", "s")] * 64, [(None, "the very same row", "en", "s")] * 64, [(5, f"row number {i % 9} of one id", "en", "s") for i in range(64)]):
        df = documents(spark, rows).repartition(8)
        assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == Counter(brute(rows)[0])
        assert jaccard.one_of_each(df).count() == len(set(brute(rows)[1]))


def test_no_documents(spark):
    assert jaccard.near_duplicates(documents(spark, [])).collect() == []
    assert jaccard.one_of_each(documents(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard.near_duplicates(documents(spark, [(None, "a b", None, None)])).collect()] == [(None, 1, 0, None)]


def test_packing():
    rnd = np.random.default_rng(1)
    v = np.sort(rnd.integers(0, 1 << 40, 500, dtype=np.uint64))
    i = rnd.integers(0, 1 << 16, 500).astype(np.uint16)
    a, b = jaccard.unpack(jaccard.pack(v, i), 500)
    assert (a == v).all() and (b == i).all()


def test_components_of_a_chain(spark):
    rnd = random.Random(5)
    ids = list(range(200))
    rnd.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(199) if i != 120]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parts = [ids[:121], ids[121:]]
    for part in parts:
        assert {got.get(x, x) for x in part} == {min(part)}


# ---- decontamination


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rnd = random.Random(2)
    for _ in range(100):
        a = [rnd.choice([b"x", b"y", b"z", b"w"]) for _ in range(rnd.randrange(1, 90))]
        b = [rnd.choice([b"x", b"y", b"z", b"v"]) for _ in range(rnd.randrange(0, 90))]
        assert decontaminate.common_length(decontaminate.bit_masks(a), len(a), b) == plain(a, b)


def test_planted_items_and_paraphrases(spark, sf):
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rnd = random.Random(4)
    planted = {}
    for n, (item, text) in enumerate(sorted(items.items())[:30]):
        host = base[5 + n][1].split(" ")
        w = text.split(" ")
        if n % 3 == 1:
            w = [x.upper() + "!!" for x in w]
        elif n % 3 == 2:
            w = [x if rnd.random() > 0.15 else "changed" for x in w]
        at = rnd.randrange(len(host))
        planted[30_000 + n] = item
        base.append((30_000 + n, " ".join(host[:at] + w + host[at:]), "en", "s"))
    long = "filler words without meaning " * 50_000
    base += [(31_000, long + items[0] + " " + long, "en", "s"), (31_001, None, None, None), (31_002, "", None, None), (None, items[1], None, None)]
    planted[31_000] = 0
    docs = widened(documents(spark, base))
    found = decontaminate.leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(d, i) for d, i in planted.items()} <= got
    assert (None, 1) in got
    # all that is found holds most of an item; all that holds one word for word is found
    texts = {i: decontaminate.words(t) for i, t, *_ in base if t}
    for d, i in got:
        if d is not None:
            item = decontaminate.made_item(i, items[i])
            assert decontaminate.common_length(decontaminate.bit_masks(item.words), len(item.words), texts[d]) / len(item.words) >= decontaminate.CLOSE
    for d, t, *_ in base:
        for i, text in items.items():
            assert t is None or text not in t or (d, i) in got
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    gone = {d for d, _ in got}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(i for i, *_ in base if i not in gone and i is not None)


def test_empty_tables(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = documents(spark, [(1, "some words here", "en", "s")])
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == 1
    assert decontaminate.leaks(docs.limit(0), bench).collect() == []
    odd_bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "some words here")], bench.schema)
    assert [r.item_id for r in decontaminate.leaks(docs, odd_bench).collect()] == [3]


def test_items_of_common_words(spark):
    rnd = random.Random(8)
    common, rare = ([f"{x}{i}" for i in range(20)] for x in "cr")
    items = [" ".join(common), " ".join(rare)]
    hosts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(30)) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    # a third of all rows are copies of one item, and few rows make every word common
    many = [(i, items[0] if i % 3 == 0 else t, "en", "s") for i, t in enumerate(hosts)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, many), bench).collect()} == {(i, 0) for i in range(0, 60, 3)}
    few = [(0, items[0], "en", "s"), (1, hosts[1], "en", "s")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, few), bench).collect()} == {(0, 0)}
    assert [r.doc_id for r in decontaminate.clean(documents(spark, few), bench).collect()] == [1]


def test_factors_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE", 10, raising=False)  # a sample would be of so many
    monkeypatch.setattr(decontaminate, "RANK", 8)
    monkeypatch.setattr(decontaminate, "OVER", 4)
    monkeypatch.setattr(decontaminate, "SUMS", 1)  # so that sums are added in two rounds
    rnd = random.Random(9)
    names = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(names[i % 50 :]) for _ in range(rnd.randrange(1, 150))) for i in range(200)]
    bench = spark.createDataFrame([(i, " ".join(rnd.sample(names, 20))) for i in range(5)], "item_id bigint, text string")
    model = decontaminate.fit(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3), bench)
    n, place = len(model.place), model.place
    rows = []
    for t in texts:
        w = decontaminate.words(t)
        for at in range(0, len(w), decontaminate.PASSAGE):
            rows.append(np.zeros(n))
            for x in w[at : at + decontaminate.PASSAGE]:
                if x in place:
                    rows[-1][place[x]] += 1
    a = np.array(rows)
    weight = np.log((len(a) + 1) / ((a > 0).sum(axis=0) + 1)) + 0.05
    assert np.allclose(model.weight[:-1], weight, atol=1e-5)
    own = np.zeros((5, n))
    for i, r in enumerate(bench.orderBy("item_id").collect()):
        for x in decontaminate.words(r.text):
            own[i, place[x]] += 1
    own = own * weight * np.sqrt(len(a) / 5)
    a = np.vstack([a * weight, own])
    y = a.T @ (a @ np.random.default_rng(41).standard_normal((n, 12)))
    q, _ = np.linalg.qr(y)
    basis = model.vectors[:-1] / model.weight[:-1, None]
    assert basis.shape == (n, 8) and np.abs(basis - q @ (q.T @ basis)).max() < 1e-3


def test_short_items_word_for_word(spark):
    rnd = random.Random(10)
    # words by Zipf's law, so that an item of few words drowns in its neighbours
    word = lambda: f"w{int(400 ** rnd.random())}"
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 5, 6, 6, 6, 8, 8, 8, 11, 14, 15, 30)]
    items += [items[5] + " " + items[6]]
    hosts = [[word() for _ in range(150)] for _ in range(60)]
    rows = [(i, " ".join([*h[:70], (items[i % 16]).upper(), *h[70:]]), "en", "s") for i, h in enumerate(hosts)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    want = {(d, i) for d, t, *_ in rows for i, item in enumerate(items) if f" {item} " in f" {t.lower()} "}
    assert want <= got and len(want) >= 60


def plain_search(text, items, model):
    """The search by its definition: every window of every item, one at a time."""
    d = decontaminate
    own, out = d.words(text), {}

    def vector(words):
        return sum((model.vectors[model.place[w]].astype(float) for w in words if w in model.place), np.zeros(model.vectors.shape[1]))

    def mass(words):
        return sum(float(model.weight[model.place[w]]) for w in words if w in model.place)

    def passages(item):
        cut = [item.words[a : a + d.PASSAGE] for a in range(0, len(item.words), d.PASSAGE)]
        return [item.words[-d.PASSAGE :] if i and len(c) < d.PASSAGE // 2 else c for i, c in enumerate(cut)]

    def width_of(item):
        return next((w for w in d.WINDOWS if min(len(item.words), d.PASSAGE) <= w), d.WINDOWS[-1])

    for item in items:
        n, w = len(item.words), width_of(item)
        for at in range(len(own) - n + 1):
            if own[at : at + n] == item.words:
                out[item.item_id] = max(out.get(item.item_id, (0, 0)), (1.0, 1.0))
        least = min(mass(p) for i in items if width_of(i) == w for p in passages(i))
        done = -1
        for s in range(0, max(len(own) - w // 2, 1), w // 4):
            x = vector(own[s : s + w])
            like = max(x @ vector(p) / max(np.linalg.norm(x) * np.linalg.norm(vector(p)), 1e-9) for p in passages(item)) if x.any() else 0
            if s <= done or mass(own[s : s + w]) < d.MASS * least or like < d.COSINE:
                continue
            done = s + w // 4
            region = own[max(0, s - n // 2 - w // 4) : s + n + n // 2 + 2 * (w // 4)]
            cover = d.common_length(d.bit_masks(item.words), n, region) / n
            answer = d.common_length(d.bit_masks(item.answer), len(item.answer), region) / len(item.answer)
            if cover >= d.EXACT or (cover >= d.CLOSE and answer >= d.CLOSE):
                out[item.item_id] = max(out.get(item.item_id, (0, 0)), (cover, answer))
    return out


def test_search_against_its_definition(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHECKED", 16)
    monkeypatch.setattr(decontaminate, "GROUP", 400)
    rnd = random.Random(12)
    word = lambda: f"w{int(500 ** rnd.random())}"
    items = [[word() for _ in range(n)] for n in (4, 9, 13, 20, 33, 47, 60, 64, 65, 90, 140)]
    texts = []
    for k in range(70):
        host = [word() for _ in range(rnd.choice((0, 3, 40, 200, 900)))]
        for item in rnd.sample(items, k % 3):
            edited = [w if rnd.random() > 0.3 else word() for w in item]
            for _ in range(k % 5):
                edited.insert(rnd.randrange(len(edited)), word())
            at = rnd.randrange(len(host) + 1)
            host[at:at] = item if k % 7 == 0 else edited
        texts.append(" ".join(host))
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    model = decontaminate.fit(docs, bench)
    made = [decontaminate.made_item(i, " ".join(t)) for i, t in enumerate(items)]
    got = list(decontaminate.searched(iter(texts), model))
    for text, held in zip(texts, got, strict=True):
        want = plain_search(text, made, model)
        assert {k: tuple(np.round(v[:2], 9)) for k, v in held.items()} == {k: tuple(np.round(v, 9)) for k, v in want.items()}, text
    assert sum(map(len, got)) > 40
    rows = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.cover, 9)) for r in rows} == {(i, k, round(v[0], 9)) for i, h in enumerate(got) for k, v in h.items()}


def test_place_in_long_texts(spark):
    rnd = random.Random(13)
    long = [f"long{i}" for i in range(2500)]  # of more than 8,192 characters
    short = [f"short{i}" for i in range(30)]
    filler = ["filler", "words"] * 150_000
    changed = [w if rnd.random() > 0.2 or i in (0, 29) else "changed" for i, w in enumerate(short)]
    text = " ".join([*filler[:160_000], *long, *filler[:9_000], *changed, *filler[:300]])
    assert len(text) > 1 << 20
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id bigint, text string")
    got = {r.item_id: (r.word, r.cover) for r in decontaminate.leaks(documents(spark, [(5, text, "en", "s"), (6, " ".join(filler), "en", "s")]), bench).collect() if r.doc_id == 5}
    assert got[1] == (160_000, 1.0)
    assert got[2][0] == 160_000 + 2500 + 9000 and 0.7 <= got[2][1] < 1
    for cut in (7, 64, 1000):  # pieces never cut a word
        decontaminate.PIECE, was = cut, decontaminate.PIECE
        try:
            assert [w for p in decontaminate.pieces("ab cd\u2028ef  gh" * 9) for w in decontaminate.words(p)] == decontaminate.words("ab cd\u2028ef  gh" * 9)
        finally:
            decontaminate.PIECE = was


def test_products_cost_little_more_than_their_rows(spark, monkeypatch):
    """op9: a task's sum over its passages, against numpy's time to read a row for each occurrence."""
    rng = np.random.default_rng(14)
    names = [f"t{i}" for i in range(4000)] + ["other"] * 4000
    texts = [" ".join(names[int(i) - 1] for i in 8000 ** rng.random(500)) for _ in range(400)] + ["", None, "other", "t5"]
    numbers = decontaminate.numbered(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).coalesce(1), [x.encode() for x in names[:4000]])
    weight, basis = rng.random(4000) + 0.1, rng.standard_normal((4000, 144))
    made, was = [], common.map_arrow
    monkeypatch.setattr(common, "map_arrow", lambda df, run, schema: made.append(run) or was(df, run, schema))
    got = decontaminate.summed(numbers, weight, basis)
    place = {x: i for i, x in enumerate(names[:4000])}
    want, occurrences = np.zeros(basis.shape), []
    for t in texts:
        w = (t or "").split()
        for at in range(0, len(w), decontaminate.PASSAGE):
            ids = np.array([place[x] for x in w[at : at + decontaminate.PASSAGE] if x in place], int)
            np.add.at(want, ids, weight[ids, None] * (weight[ids, None] * basis[ids]).sum(axis=0))
            occurrences.append(ids)
    assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()

    def least(f):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    monkeypatch.setattr(decontaminate, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batches = numbers.filter("ids is not null").select("ids", "sizes").toArrow().to_batches()
    cells, ids = basis.astype(np.float32), np.concatenate(occurrences)
    read = least(lambda: [cells[ids[at : at + 10_000]] for at in range(0, len(ids), 10_000)])
    assert least(lambda: list(made[0](iter(batches)))) < 3 * read


@pytest.mark.parametrize("common_at", [1, 3, 10**9])
def test_products_of_passages(common_at, monkeypatch):
    monkeypatch.setattr(decontaminate, "COMMON", common_at)
    rng = np.random.default_rng(15)
    for passages in (0, 1, 2, 60):
        size = rng.integers(1, 9, passages)
        ids, number = (20 * rng.random(size.sum()) ** 3).astype(np.uint16), np.repeat(np.arange(passages), size)
        c = np.zeros((passages, 22))
        np.add.at(c, (number, ids), 1)
        scaled = rng.standard_normal((22, 5)).astype(np.float32)
        out = np.ones((22, 5))
        decontaminate.add_products(out, scaled, ids, number, passages)
        assert np.allclose(out, 1 + c.T @ (c @ scaled), atol=1e-3)


def test_numbers_of_words(monkeypatch):
    terms = [b"aa", b"b", "é".encode(), "ß9".encode()]
    texts = ["", None, "  ", "aa", " AA\tb. ", "É,ß9\u2028b  -  É", "?", "x" * 90 + " b", "aa " * 50, "no\nterm", ""]
    want = [[terms.index(w) if w in terms else -1 for w in decontaminate.words(t or "")] for t in texts]
    for cut, each in ((1 << 20, 16), (1, 0), (7, 0), (30, 0), (30, 16)):
        monkeypatch.setattr(decontaminate, "PIECE", cut)
        monkeypatch.setattr(decontaminate, "FOR_TERM", each)
        assert [own.tolist() for own in decontaminate.numbers_of(iter(texts), terms)] == want
        assert list(decontaminate.numbers_of(iter([]), terms)) == []
        assert [own.tolist() for own in decontaminate.numbers_of(iter([None, ""]), terms)] == [[], []]


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_shuffles_behind_a_checkpoint_are_freed(spark):
    """what a checkpoint has made needless leaves the disk while a query goes on."""
    before = shuffled(spark)
    made = spark.range(300_000).withColumn("x", F.md5(F.col("id").cast("string"))).repartition(5, "x")
    assert common.settled(made).count() == 300_000
    assert shuffled(spark) < before + 1_000_000
    assert common.settled(made.groupBy("x").count()).count() == made.count() == 300_000


@pytest.mark.parametrize("wide", [4, 5, 512])
def test_similar_documents_meet_few_times(spark, wide):
    """a pair that meets in many shingles is shuffled a few times only; none is lost."""
    rnd = random.Random(3)
    rows = []
    for c in range(30):
        for k in range(rnd.choice([2, 3, 9])):
            own = [s for s in range(120) if rnd.random() < 0.97]
            rows += [(c * 1000 + s, c * 100 + k, 320, p) for p, s in enumerate(own)]
            rows.append((-7, c * 100 + k, 320, 0 if c < 6 else 100))  # a shingle of all
    df = spark.createDataFrame(rows, "shingle bigint, node bigint, n int, pos int").repartition(3)
    by, want = {}, set()
    for s, node, n, pos in rows:
        by.setdefault(s, []).append((node, n, pos))
    for met in by.values():
        for a, na, pa in met:
            for b, nb, pb in met:
                need = -(-60 * (na + nb) // 160)
                if a < b and 100 * na >= 60 * nb and 100 * nb >= 60 * na and na - pa >= need and nb - pb >= need:
                    want.add((a, b))
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        met = [tuple(r) for r in jaccard.meetings(df, wide).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert set(met) == want and len(want) > 300
    if wide == 512:
        assert len(met) < 6 * len(want)


def test_bitmaps_drop_chance_pairs_and_no_link():
    """long texts that share few shingles are told apart without comparing them whole; the
    bound is never below the overlap."""
    rnd = np.random.default_rng(5)

    def drawn(n):
        return np.unique(rnd.integers(0, 1 << 64, n, np.uint64))

    def bound(a, b):
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        if len(x) < len(y):
            a, b, x, y = b, a, y, x
        return jaccard.shared_bound(x, y, len(b) - int(np.bitwise_count(y).sum()))

    for n in (1, 2, 15, 16, 17, 100, 1000, 5000):
        for m in (n, max(1, int(n * 0.6)), n + 1):
            common = drawn(min(n, m))
            for share in (0.0, 0.3, 0.6, 0.75, 0.9, 1.0):
                own = common[: int(share * len(common))]
                a, b = (np.unique(np.concatenate([own, drawn(k - len(own))])) for k in (n, m))
                assert bound(a, b) >= len(np.intersect1d(a, b))
                if share <= 0.3 and n >= 100:
                    assert bound(a, b) < 0.375 * (n + m)
    # hashes that all fall on few bits
    a = np.arange(900, dtype=np.uint64) << np.uint64(40)
    assert bound(a, a[:700]) >= 700

    class Counted(np.ndarray):
        """An array that counts its look-ups."""

        met = 0

        def searchsorted(self, *args, **kw):
            if np.size(args[0]) > 16:
                Counted.met += 1
            return np.asarray(self).searchsorted(*args, **kw)

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words, 1500)) for _ in range(12)]
    texts.append(texts[0] + " and more")
    rows = [(a, -1, t.encode(), 1) for a, t in enumerate(texts)]
    rows += [(a, b, None, 0) for b in range(len(texts)) for a in range(b)]
    pdf = jaccard.pd.DataFrame(rows, columns=["a", "b", "text", "copies"])
    was = jaccard.shingles
    try:
        jaccard.shingles = lambda raw: was(raw).view(Counted)
        found = jaccard.verified(pdf)
    finally:
        jaccard.shingles = was
    sets = [shingle_set(t) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    assert set(zip(found["a"], found["b"], strict=True)) == want == {(0, 12)}
    assert Counted.met == 1, Counted.met


def test_bounds_of_a_block_are_computed_together(monkeypatch):
    """no call for each pair; the bounds are those of ``shared_bound``."""
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 1 << 64, n, np.uint64)) for n in rnd.integers(1, 900, 60)]
    sets += [np.unique(np.concatenate([s[rnd.random(len(s)) < 0.8], s[:1]])) for s in sets]
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    maps, sizes = [jaccard.bitmap(s) for s in sets], np.array([len(s) for s in sets])

    def one(a, b):
        a, b = (b, a) if len(maps[a]) < len(maps[b]) else (a, b)
        return jaccard.shared_bound(maps[a], maps[b], sizes[b] - int(np.bitwise_count(maps[b]).sum()))

    want = [one(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    monkeypatch.setattr(jaccard, "shared_bound", None)
    assert jaccard.shared_bounds(maps, sizes, i, j).tolist() == want
    pdf = jaccard.pd.DataFrame([(k, -1, m.tobytes(), n) for k, (m, n) in enumerate(zip(maps, sizes, strict=True))] + [(a, b, None, 0) for a, b in zip(i, j, strict=True) if a < b], columns=["a", "b", "map", "n"])
    kept = jaccard.screened(pdf)
    stays = {(a, b) for a, b, s in zip(i.tolist(), j.tolist(), want, strict=True) if a < b and 160 * s >= 60 * (sizes[a] + sizes[b])}
    assert set(zip(kept["a"], kept["b"], strict=True)) == stays


def test_pairs_of_chance_share_blocks(spark, monkeypatch):
    """many small clusters are few blocks, of bounded size; each has the classes of its pairs."""
    classes = spark.range(400).select(F.col("id").alias("node"), F.lit(100).cast("bigint").alias("n"))
    pairs = spark.range(200).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
    carried = classes.select("node", F.lit(b"x").alias("text"), F.lit(1).cast("bigint").alias("copies"))
    for part, most in ((jaccard.PART, 1), (2000, 10)):
        monkeypatch.setattr(jaccard, "PART", part)
        blocks = {}
        for r in jaccard.gathered(classes, pairs, carried).collect():
            blocks.setdefault(r.block, ([], []))[r.b >= 0].append((r.a, r.b))
        assert len(blocks) <= most
        assert sorted(p for _, ps in blocks.values() for p in ps) == [(2 * k, 2 * k + 1) for k in range(200)]
        for own, ps in blocks.values():
            assert sorted(a for a, _ in own) == sorted({x for p in ps for x in p})


def test_texts_of_chance_pairs_stay(spark, monkeypatch):
    rng = random.Random(11)
    pieces = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(40)]
    rows = [(i, " ".join(rng.sample(pieces, 10)), "en", "s") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " at the end", "en", "s") for i in range(4)]
    was, met, told = (jaccard.candidates, jaccard.class_texts, jaccard.links), {}, []

    def seen(name, f, at):
        def run(*args):
            out = f(*args)
            met[name] = (out if at is None else args[at]).count()
            told.append(name)
            return out

        return run

    for name, f, at in (("candidates", was[0], None), ("class_texts", was[1], 2), ("links", was[2], 1)):
        monkeypatch.setattr(jaccard, name, seen(name, f, at))
    for few in (0, jaccard.BROADCAST_CLASSES):
        monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", few)
        assert Counter(tuple(r) for r in jaccard.near_duplicates(documents(spark, rows)).collect()) == Counter(brute(rows)[0])
        held = sum(r[2] for r in brute(rows)[0]) // 2
        assert met["candidates"] > 100 > 20 > met["class_texts"] == met["links"] >= held >= 4
