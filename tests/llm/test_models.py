from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathloom.llm import common, langid, queries, quality, toxicity
from tests.llm.fixtures import documents, odd, widened

SF = "/root/testdata/sf0.01"


def held(doc_id, mod, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.queries()["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def test_language_of_odd_rows(spark, sf):
    df = widened(documents(spark, odd(spark, sf)))
    got = langid.language(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == df.count()
    assert [by[i][0].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und"] * 4 and by[9001][0].score == 0
    assert {r.held_out for r in by[None]} == {False}
    assert by[9005][0].lang_pred == "en"
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert {9001, 9002, 9003, 9004}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() == len(got) - 5


def test_many_languages(spark):
    import random

    rnd = random.Random(6)
    rows = []
    for k in range(80):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)]
        rows += [(100 * k + i, " ".join(rnd.choices(own, k=40)), f"l{k:02}", "s") for i in range(8)]
    truth = {i: lang for i, _, lang, _ in rows}
    got = langid.language(documents(spark, rows)).collect()
    learned = {truth[r.doc_id] for r in got if not r.held_out}
    assert {r.lang_pred for r in got if not r.held_out} == learned and len(learned) == 80
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.95


def test_language_without_documents_or_labels(spark):
    assert langid.language(documents(spark, [])).collect() == []
    only = documents(spark, [(1, "some text", None, "s")])
    assert [tuple(r)[2:] for r in langid.language(only).collect()] == [("und", 0.0)]
    assert langid.keep_known(only).collect() == []


@pytest.mark.parametrize(("name", "label", "mod", "rest", "cut"), [("op3_toxicity", "toxic", 4, 2, 0.3), ("op8_quality", "quality", 3, 1, 0.5)])
def test_labels_are_learned(spark, name, label, mod, rest, cut):
    truth = {r.doc_id: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}
    rows = queries.queries()[name](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == held(r.doc_id, mod, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > (0.93 if label == "toxic" else 0.97)


@pytest.mark.parametrize(("module", "label", "fold"), [(toxicity.toxicity, "toxic", (4, 2)), (quality.quality, "quality", (3, 1))])
def test_odd_rows_and_labels(spark, sf, module, label, fold):
    df = widened(documents(spark, odd(spark, sf)))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 0), (1, 0, 0)], labels.schema)
    got = module(df, labels.unionByName(more)).collect()
    assert len(got) == df.count()
    score = {r.doc_id: r.score for r in got}
    assert score[9001] == score[9002] == score[9003]
    assert all(0 <= s <= 1 for s in score.values())
    empty = labels.limit(0)
    assert {r.score for r in module(df, empty).collect()} == ({0.0} if label == "toxic" else {0.5})
    assert module(df.limit(0), labels).collect() == []


def test_toxicity_of_more_rows_than_a_part(spark):
    """the parts of a batch are told whole, and as row by row."""
    rows = [(i, f"you {('idiot', 'friend')[i % 2]} number {i % 50} " * (1 + i % 3) if i % 97 else None, "en", "s") for i in range(2 * common.PART_ROWS + 5)]
    df = documents(spark, rows).coalesce(1)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id bigint, toxic int, quality int")
    score = toxicity.scorer(toxicity.train(df, labels, ~common.held_out(F.col("doc_id"), 4, 2)))
    got = toxicity.toxicity(df, labels).collect()
    assert [(r.doc_id, r.score) for r in got] == [(i, score((t or "").encode())) for i, t, *_ in rows]
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id % 97)


def test_quality_of_more_rows_than_a_part(spark):
    """the parts of a batch are told whole, and as row by row, in learning too."""
    rows = [(i, f"{('buy cheap', 'a careful')[i % 2]} number {i % 50} " * (1 + i % 3) if i % 97 else None, "en", "s") for i in range(2 * common.PART_ROWS + 5)]
    df = documents(spark, rows).coalesce(1)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1800)], "doc_id bigint, toxic int, quality int")
    score = quality.scorer(quality.train(df, labels, ~common.held_out(F.col("doc_id"), 3, 1)))
    got = quality.quality(df, labels).collect()
    assert [(r.doc_id, r.score) for r in got] == [(i, score((t or "").encode())) for i, t, *_ in rows]
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id % 97)


def test_long_texts_are_read_to_the_end():
    raw = langid.folded("a" * 20_000 + "zq")
    parts = list(langid.passages(raw))
    assert len(parts) == 5 and parts[-1].endswith(b"zq ") and b"".join(p[: langid.PASSAGE] for p in parts[:-1]) + parts[-1] == raw
    grams = {p[i : i + n] for p in parts for n in (2, 3, 4) for i in range(len(p) - n + 1)}
    assert grams == {raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)}
    text = "ab " * (toxicity.PIECE // 3 + 5) + "idiot"
    assert set(toxicity.features("ab idiot".encode())) <= set(toxicity.features(text.encode()))
    many = list(quality.cells(b"word " * 60000 + b"final"))
    assert sum(len(c) for c in many if len(c)) > 60000


# ---- against plain versions


def gram_hash(gram, bits, extra=0):
    """The hash of a byte n-gram, one byte at a time."""
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x01000193 + c) % (1 << 32)
    return (((h + extra) % (1 << 32) ^ (h >> 15)) * 0x2C1B3C6D) % (1 << 32) >> (32 - bits)


def spectrum(raw, orders, bits):
    return [gram_hash(raw[i : i + n], bits) for n in orders for i in range(len(raw) - n + 1)]


def test_language_scores_against_dense_kernels(spark):
    """With every learned text a landmark, Nystroem's scores are those of weighted kernel ridge
    regression on the whole kernel matrix."""
    rnd = random.Random(7)
    words = {lang: ["".join(rnd.choice(chars) for _ in range(rnd.randrange(2, 9))) for _ in range(60)] for lang, chars in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnopé"))}
    rows = [(lang, " ".join(rnd.choices(own, k=rnd.randrange(3, 60)))) for lang, own in words.items() for _ in range(25)]
    langs, texts = [r[0] for r in rows], [r[1] for r in rows]
    model = langid.fit([langid.learned(t) for t in texts], langs, landmarks=len(rows), ridge=0.1)

    def cells(text):
        return set(spectrum(langid.folded(text), langid.ORDERS, langid.BITS))

    known = [cells(t) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in known] for a in known])
    y = np.array([[1.0 if lang == name else -1.0 for name in ("aa", "bb", "cc")] for lang in langs])
    w = np.full(len(rows), 1 / 25)
    # minimum of sum w (k c - y)^2 + r c'k c
    r = 0.1 * w.sum() / 3
    c = np.linalg.solve(np.diag(w) @ k + r * np.eye(len(rows)), np.diag(w) @ y)
    fresh = [" ".join(rnd.choices(words[lang], k=20)) for lang in words for _ in range(5)]
    present = np.zeros((len(fresh), langid.DIM), np.uint8)
    for row, t in zip(present, fresh, strict=True):
        langid.mark(langid.folded(t), row)
        assert set(np.flatnonzero(row)) == cells(t)
    want = np.array([[kernel(cells(t), x) for x in known] for t in fresh]) @ c
    assert np.abs(model.scores(present) - want).max() < 2e-3


def test_long_texts_keep_their_language(spark):
    rnd = random.Random(9)
    words = {lang: ["".join(rnd.choice(chars) for _ in range(rnd.randrange(3, 10))) for _ in range(3000)] for lang, chars in (("aa", "aeioubcdfgh"), ("bb", "aeioujklmnp"), ("cc", "aeiouqrstvw"))}
    rows = [(i, " ".join(rnd.choices(words[lang], k=150)), lang, "s") for i, lang in enumerate(list(words) * 40)]
    rows += [(1000 + i, " ".join(rnd.choices(words[lang], k=200_000)), None, "s") for i, lang in enumerate(words)]
    got = {r.doc_id: r for r in langid.language(documents(spark, rows)).filter("doc_id >= 1000").collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {1000: "aa", 1001: "bb", 1002: "cc"}
    assert min(r.score for r in got.values()) > 0.8


def test_toxic_features_by_plain_counts(spark):
    texts = ["You  are bad!", "you are GOOD", "", "bad bad bad", "né à"]
    for t in texts:
        low = re.sub(rb"  +", b" ", b" " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in t.lower().encode()) + b" ")
        assert set(toxicity.features(t.encode())) == set(spectrum(low, toxicity.ORDERS, toxicity.BITS))
    rows = [(i, rnd_text(i), "en", "s") for i in range(60)]
    labels = [(i, 0, i % 2) for i in range(60)]
    made = documents(spark, rows).join(spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id bigint, label int"), "doc_id")
    ones, zeros = toxicity.counted(made)
    want = np.zeros((2, toxicity.TABLE), int)
    for (i, t, *_), (_, _, label) in zip(rows, labels, strict=True):
        want[label, list(set(toxicity.features(t.encode())))] += 1
    assert (ones == want[1]).all() and (zeros == want[0]).all()
    kept, ratio = toxicity.chosen(ones, zeros, 30, 30, widest=50)
    told = {int(k): float(r) for k, r in zip(kept, ratio, strict=True)}

    def plain(f):
        p, q = want[1, f], want[0, f]
        r = math.log((p + 0.5) / 31) - math.log((q + 0.5) / 31)
        return r, abs(r) / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)), p + q

    ranked = sorted((-plain(f)[1], f) for f in np.flatnonzero(want.sum(axis=0)).tolist() if plain(f)[2] >= 3)[:50]
    assert told == pytest.approx({f: plain(f)[0] for s, f in ranked if s < 0})
    # a text is scored by the sum of its features' weights
    weights, bias = toxicity.fit([np.flatnonzero(np.isin(kept, toxicity.features(t.encode()))) for _, t, *_ in rows], np.array([x for *_, x in labels], float), kept, ratio)
    score = toxicity.scorer((weights, bias))
    for _, t, *_ in rows[:10]:
        z = bias + sum(float(weights[f]) for f in set(toxicity.features(t.encode())))
        assert score(t.encode()) == pytest.approx(1 / (1 + math.exp(-z)))


def rnd_text(i):
    rnd = random.Random(i)
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "rude", "nice"] if i % 2 else ["alpha", "beta", "gamma", "calm", "nice"]) for _ in range(rnd.randrange(1, 12)))


def test_quality_cells_by_a_plain_loop():
    def plain(text):
        out = []
        words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text) if w]
        hashed = []
        for w in words:
            h = sum(int(quality.CODES[c]) * pow(quality.MULT, j, 1 << 64) for j, c in enumerate(w)) % (1 << 64)
            h = h * quality.MULT % (1 << 64)  # the blank before it has the first power
            h ^= h >> 31
            hashed.append(h)
            out.append(h * 0x94D049BB133111EB % (1 << 64) >> (64 - quality.BITS))
            marked = b" " + w + b" "
            out += [gram_hash(marked[i : i + n], quality.BITS, n) for n in (3, 4) for i in range(len(marked) - n + 1)]
        return sorted(out + [quality.AGAIN for a, b in zip(hashed, hashed[1:], strict=False) if a == b])

    for t in ("one two  two three", "a", "", " \n", "né bien\tbien", "x y z x y"):
        assert sorted(np.concatenate([*quality.cells(t.encode()), np.zeros(0, np.int32)]).tolist()) == plain(t.encode()), t


def test_quality_scores_are_means_of_learned_vectors():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("good fine clear".split() if i % 2 else "spam spam junk".split()) for _ in range(8)) for i in range(40)]
    table, bias = quality.fit([quality.features(t.encode()) for t in texts], np.array([i % 2 for i in range(40)], float))
    score = quality.scorer((table, bias))
    for i, t in enumerate(texts):
        own = np.concatenate(list(quality.cells(t.encode())))
        assert score(t.encode()) == pytest.approx(1 / (1 + math.exp(-(bias + float(table[own].astype(float).mean())))))
        assert (score(t.encode()) > 0.5) == bool(i % 2)


def test_samples_are_bounded_whatever_the_texts(spark, sf):
    """One doc_id has many rows and very long texts: what the driver gathers stays small."""
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rnd = random.Random(3)
    some = [r.doc_id for r in labels.collect()][:20]
    long = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(40_000)), "en", "s") for i in some]
    df = documents(spark, base + long + [base[3]] * 500)
    usable = labels.filter("doc_id is not null")
    model = quality.train(df, usable, quality.F.lit(True), most=50_000)
    assert model is not None and np.isfinite(model[0]).all()
    again = quality.train(df.repartition(7), usable, quality.F.lit(True), most=50_000)
    assert (model[0] == again[0]).all() and model[1] == again[1]
    one, two = (langid.train(x, langid.F.lit(True)) for x in (df, df.repartition(5)))
    assert (one.weights == two.weights).all()
