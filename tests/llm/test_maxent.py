import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lontar.llm import maxent

DOCS = "doc_id long, text string, block int, codes string"


def corpus(seed, n=150):
    r = random.Random(seed)
    common, rare = "the of and to in".split(), [f"{r.choice('abcdefgh')}{i}{r.choice(['ing', 'ed', 'ly'])}" for i in range(400)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(r.randint(0, 60)):
            words += [r.choice(common), rare[min(int(r.expovariate(0.02)), 399)]] if r.random() < 0.7 else ["New", "york"]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (3, "the Éa"), (None, "no id of"), (900, None), (901, ""), (902, " \r\n"), rows[5]]


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


@pytest.fixture
def fine(monkeypatch):
    """Limits that make a small corpus need all that a large one does."""
    monkeypatch.setattr(maxent, "LEAF_TOKENS", 12)
    monkeypatch.setattr(maxent, "FREQUENT_SHARE", 40)


def test_base_columns(spark):
    rows = corpus(1)
    got = maxent.score_documents(spark.createDataFrame([(*x, 1, "clash") for x in rows], DOCS).repartition(3), block_bytes=4000, group_bytes=3000).collect()
    counts = Counter(w for d, t in rows if not held_out(d) for w in [*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        ts = [*words_of(t), b""]
        want.append((d is None, d or 0, held_out(d), len(ts), sum(counts[w] > 0 for w in ts), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts), 6)))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == sorted(want)
    assert all(x.score < 0 for x in got)


def by_hand(rows, leaf, often_from):
    """Each word's way (parts of classes) and its share of its last class, from the corpus alone."""
    counts = Counter(w for d, t in rows if not held_out(d) for w in [*words_of(t), b""])
    every = {w for _, t in rows for w in words_of(t)}
    key = {w: int(maxent.word_keys([w])[0]) for w in every}
    often = sorted((w for w in every if counts[w] >= often_from), key=lambda w: (-counts[w], -key[w]))
    nibbles = {w: [(key[w] >> (60 - 4 * i)) & 15 for i in range(7)] for w in every}
    digits = 1
    while 16**digits < len(often) + 1:
        digits += 1
    ways = {w: [0, *((i >> (4 * (digits - 1 - k))) & 15 for k in range(digits))] for i, w in enumerate([b"", *often])}
    share = dict.fromkeys(ways, 1.0)
    others = every - set(often)
    for w in others:
        for depth in range(1, 8):
            same = [x for x in others if nibbles[x][:depth] == nibbles[w][:depth]]
            total = sum(counts[x] for x in same)
            if depth == 7 or total - max(counts[x] for x in same) < leaf:
                break
        ways[w] = nibbles[w][:depth]
        share[w] = (counts[w] + 1) / (total + sum(counts[x] > 0 for x in same) + 1)
    return counts, ways, share


def soft(model, way, level, history):
    """The softmax over the parts of the class that a way has reached, straight from the definition."""
    mask = (1 << 64) - 1
    mix = [int(m) for m in maxent._MIX]
    number = 0
    for p in way[:level]:
        number = number * 16 + p
    node = number << 3 | level
    salt = (node + 1) * mix[0] & mask
    row = lambda x: ((x ^ (x >> 31)) * mix[4] & mask) >> (64 - model.bits)
    logits = model.reference[row(salt)].astype(float)
    for family, (h, m) in enumerate(zip(history, mix[1:3], strict=True)):
        logits = logits + model.weights[family][row((h * m & mask) ^ salt)]
    p = np.exp(logits)
    return p / p.sum()


def code(way):
    number = 0
    for p in way:
        number = number * 16 + p
    return len(way) << 28 | number << (28 - 4 * len(way))


@pytest.mark.parametrize("block, group", [(1 << 20, 1 << 20), (4000, 3000)])
def test_scores_are_recomputed_from_the_model(spark, fine, block, group):
    rows = corpus(2)
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], DOCS).repartition(2)
    coded, model, tokens, size = maxent.coded_texts(docs, block_bytes=block, group_bytes=group)
    shape = maxent.Shape(size, group)
    counts, ways, share = by_hand(rows, shape.leaf, shape.often)
    if shape.always == 0:  # else upper classes are always divided
        own = {maxent.word_keys([w])[0]: w for w in ways if w}
        assert own and max(len(w) for w in ways.values()) > 2
    maxent.train(coded, model, size)
    assert np.abs(model.weights).max() > 0.1
    sent = spark.sparkContext.broadcast(model)
    got = {(x.doc_id, round(x.base_score, 6)): x.score for x in coded.mapInArrow(maxent._scorer(sent, tokens), maxent.SCHEMA).collect()}
    start = 0xFFFFFFFF
    if shape.always == 0:
        for d, t in rows:
            one = two = start
            total = 0.0
            ts = [*words_of(t), b""]
            for w in ts:
                for level, p in enumerate(ways[w]):
                    total += math.log10(soft(model, ways[w], level, (one, two))[p])
                total += math.log10(share[w])
                one, two = code(ways[w]), one
            base = sum(math.log10((counts[w] + 1) / (tokens + len(counts) + 1)) for w in ts)
            assert abs(got[d, round(base, 6)] - total) < 1e-3 * len(ts)
        # All known words and one unknown word for each last class share what there is.
        known = {w for w in ways if counts[w] > 0}
        total, last = 0.0, {}
        for w in known:
            p = math.prod(soft(model, ways[w], level, (start, start))[x] for level, x in enumerate(ways[w]))
            total += p * share[w]
            last.setdefault(tuple(ways[w]), []).append((p, share[w]))
        total += sum(v[0][0] * (1 - sum(s for _, s in v)) for v in last.values())
        assert 0.5 < total <= 1.0 + 1e-6


def test_the_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    table = np.zeros((1 << 6, maxent.WIDTH))
    codes = (np.uint32(2) << np.uint32(28)) | (r.integers(0, 256, 300).astype(np.uint32) << np.uint32(20))
    n = np.array([100, 150, 50])
    model = maxent.Model(6, table)
    model.weights = r.normal(0, 0.3, model.weights.shape).astype(np.float32)
    seen, due = np.zeros_like(model.weights), np.zeros_like(model.weights)
    model.gradient(codes, n, seen, due)
    g = seen - due
    before = model.log10(codes, n).sum() * math.log(10)
    for f, row, k in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:5]]:
        model.weights[f, row, k] += 0.01
        assert abs((model.log10(codes, n).sum() * math.log(10) - before) / 0.01 - g[f, row, k]) < 0.05 * abs(g[f, row, k]) + 0.05
        model.weights[f, row, k] -= 0.01


def test_it_learns_what_follows_what(spark):
    r = random.Random(4)
    after = {w: r.choice("abcdefghijklmnop") + "ing" for w in (f"w{i}" for i in range(20))}
    rows = [(d, " ".join(x for w in r.choices(list(after), k=60) for x in (w, after[w]))) for d in range(400)]
    got = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n + 0.2


@pytest.mark.parametrize("most", [1, 7])
def test_no_row_is_lost_where_blocks_span_files(spark, most):
    rows = corpus(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        got = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_bytes=8000).select("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(str(x.doc_id) for x in got) == sorted(str(d) for d, _ in rows)


def test_nothing(spark):
    assert maxent.score_documents(spark.createDataFrame([], DOCS)).collect() == []
    only = spark.createDataFrame([(d, "a b") for d in range(200) if held_out(d)], "doc_id long, text string")
    assert {(x.train_tokens, x.n_known) for x in maxent.score_documents(only).collect()} == {(0, 0)}


def test_words_are_split_and_lowered_as_bytes():
    texts = ["A\x1cb  Cé D\nÀ", "", " \t", "x" * 5000]
    keys, index, n = maxent.tokens(pa.array([t.encode() for t in texts]).slice(0))
    want = [w for t in texts for w in [*words_of(t), None]]
    assert n.tolist() == [len(words_of(t)) + 1 for t in texts]
    assert [int(keys[i]) for i in index] == [0 if w is None else int(maxent.word_keys([w])[0]) for w in want]


def test_the_model_grows_with_the_corpus_at_any_size():
    shapes = [maxent.Shape(int(size)) for size in (1e8, 5e8, 3e10, 1e12, 1e14)]
    assert all(a.bits < b.bits for a, b in zip(shapes[:-1], shapes[1:], strict=True))
    leaves = [size / maxent.TOKEN_BYTES / s.leaf for size, s in zip((1e8, 5e8, 3e10, 1e12, 1e14), shapes, strict=True)]
    assert all(a < b for a, b in zip(leaves[:-1], leaves[1:], strict=True))
    assert all(n < 16 ** maxent.LEVELS for n in leaves)


def test_sums_at_scattered_places_two_parts_at_once():
    r = np.random.default_rng(5)
    codes = (np.uint32(3) << np.uint32(28)) | (r.integers(0, 4096, 9000).astype(np.uint32) << np.uint32(16))
    n = np.array([4000, 5000])
    model = maxent.Model(6, r.integers(0, 50, (1 << 6, maxent.WIDTH)))
    model.weights = r.normal(0, 0.3, model.weights.shape).astype(np.float32)
    seen, due = np.zeros_like(model.weights), np.zeros_like(model.weights)
    model.gradient(codes, n, seen, due)
    want_seen, want_due, score = np.zeros(seen.shape), np.zeros(due.shape), np.zeros(len(codes))
    for at, reference, rows, y in model.events(codes, n):
        p, total = model.shares(reference, rows)
        score[at] += np.log10(p[np.arange(len(p)), y] / total)
        for f, own in enumerate(rows):
            np.add.at(want_seen[f], (own, y), 1)
            np.add.at(want_due[f], own, p / total[:, None])
    assert (seen == want_seen).all() and np.allclose(due, want_due, rtol=1e-3)
    assert np.allclose(model.log10(codes, n), score, atol=1e-5)


@pytest.mark.parametrize("bits, wide, piece", [(4, False, 1 << 15), (4, True, 50), (12, True, 1 << 15), (12, False, 10)])
def test_gradients_are_the_sums_of_single_softmaxes(monkeypatch, bits, wide, piece):
    monkeypatch.setattr(maxent, "PIECE", piece)
    r = np.random.default_rng(5)
    model = maxent.Model(bits, r.integers(0, 50, (1 << bits, maxent.WIDTH)))
    model.weights = r.normal(0, 0.5, model.weights.shape).astype(np.float32)
    n = np.array([1, 120, 30, 1, 48])
    levels = r.integers(1, 8, 200).astype(np.uint32)
    codes = (levels << np.uint32(28)) | (r.integers(0, 1 << 28, 200).astype(np.uint32))
    start = np.ones_like(model.weights)  # sums are added to what is there
    seen, due = start.copy(), start.astype(float) if wide else start.copy()
    model.gradient(codes, n, seen, due)
    wanted_seen, wanted_due = start.astype(float), start.astype(float)
    for _, reference, rows, y in model.events(codes, n):
        p = model.softmax(reference, rows)
        for i in range(len(y)):
            for f in range(maxent.FAMILIES):
                wanted_seen[f, rows[f][i], y[i]] += 1
                wanted_due[f, rows[f][i]] += p[i]
    assert (seen == wanted_seen).all() and np.allclose(due, wanted_due, rtol=1e-5)
    whole = np.zeros(200)
    for at, reference, rows, y in model.events(codes, n):
        whole[at] += np.log10(model.softmax(reference, rows)[np.arange(len(y)), y])
    assert np.allclose(model.log10(codes, n), whole, atol=1e-4)
    none = np.zeros_like(model.weights)
    model.gradient(codes[:0], n[:0], none, none)
    assert not none.any()


def test_sums_of_many_small_shares_keep_their_digits():
    """Added one by one as 32-bit numbers (as before), shares of a row that very many tokens have lose a part of their sum."""
    model = maxent.Model(4, np.zeros((1 << 4, maxent.WIDTH)))
    model.weights += np.random.default_rng(6).normal(0, 1, maxent.WIDTH).astype(np.float32)
    codes = np.full(600_000, 1 << 28, np.uint32)
    seen, due = np.zeros_like(model.weights), np.zeros(model.weights.shape)
    model.gradient(codes, np.array([len(codes)]), seen, due)
    assert np.allclose(due.sum(axis=2, dtype=float), seen.sum(axis=2, dtype=float), rtol=2e-6, atol=1e-2)


def test_an_unpickled_model_adds_by_the_fast_way(monkeypatch):
    """As in a worker: what is made like its arrays has a data type object of its own, with which additions took twice as long."""
    model = pickle.loads(pickle.dumps(maxent.Model(6, np.zeros((1 << 6, maxent.WIDTH)))))
    codes = np.full(50, 1 << 28, np.uint32)
    assert np.zeros_like(model.weights).dtype is not np.dtype(np.float32)
    real, targets = np.add, []

    class Add:
        def at(self, to, where, what):
            targets.append(to.dtype)
            real.at(to, where, what)

    monkeypatch.setattr(maxent.np, "add", Add())
    model.gradient(codes, np.array([50]), np.zeros_like(model.weights), np.zeros_like(model.weights))
    assert targets and all(t is np.dtype(t.type) for t in targets)
