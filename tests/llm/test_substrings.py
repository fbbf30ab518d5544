import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lontar.llm import substrings
from lontar.llm.blocks import Files, block_rows, files_of, in_blocks

DOCS = "doc_id long, text string, block int, id string, removed long"


def by_hand(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - 12 if d is not None else 0):
            first[tuple(ws[i : i + 13])] = min(d, first.get(tuple(ws[i : i + 13]), d))
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - 12 if d is not None else 0):
            if first[tuple(ws[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d is None, d or 0, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows(seed):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n)] for n in (13, 14, 30, 200, 12)]
    out = []
    for d in r.sample(range(1000), 60):
        ws = []
        for _ in range(r.randint(0, 6)):
            ws += r.choice(passages) if r.random() < 0.5 else [f"{r.choice('the of and'.split())}" for _ in range(r.randint(1, 30))]
            ws += [f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 9))]
        out.append((d, r.choice([" ", "\n", " \t "]).join(ws)))
    out += [out[0], (out[1][0], out[2][1]), (None, out[3][1]), (1001, None), (1002, ""), (1003, "\x1cé " * 20), (1004, "\x1cé " * 20), (1005, "long " * 30_000)]
    r.shuffle(out)
    return out


# spare: so few bits that fingerprints of different windows agree
@pytest.mark.parametrize("seed, block, group, spare", [(1, 1 << 24, 1 << 20, 10), (2, 4000, 500, 10), (3, 30_000, 300, 10), (4, 4000, 100, -30), (5, 2000, 1000, -12)])
def test_against_all_windows(spark, seed, block, group, spare):
    data = rows(seed)
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in data], DOCS).repartition(3)
    got = substrings.find_repeats(docs, block_bytes=block, group_suffixes=group, spare=spare).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in got) == by_hand(data)
    assert all(sum(y.end - y.start for y in x.removed) == x.n_removed for x in got)
    kept = substrings.without_repeats(docs, count_col="removed", block_bytes=block, group_suffixes=group, spare=spare).collect()
    again = sorted((x.doc_id is None, x.doc_id or 0, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")).encode()).hexdigest()) for x in kept)
    assert again == sorted((a, b, e) for a, b, _, _, e in by_hand(data))
    assert all(x.block == 1 and x.id == "clash" for x in kept)


@pytest.mark.parametrize("most", [1, 7])
def test_no_row_is_lost_where_blocks_span_files(spark, most):
    data = rows(6)
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in data], DOCS).repartition(2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        got = substrings.find_repeats(docs, block_bytes=20_000).collect()
        kept = substrings.without_repeats(docs, block_bytes=20_000).count()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in got) == by_hand(data)
    assert kept == len(data)


def test_a_block_with_another_number_of_rows_raises(spark):
    blocks = in_blocks(spark.createDataFrame([(1, b"a")], "id long, text binary"), "text", 100, "blocks")
    row = files_of(blocks).first()
    assert [len(b) for b in Files(row.block, [(row.path, 1)]).batches(["id"])] == [1]
    with pytest.raises(RuntimeError):
        list(Files(row.block, [(row.path, 2)]).batches(["id"]))
    with pytest.raises(RuntimeError):
        list(block_rows(iter([pa.RecordBatch.from_pylist([{"block": 1, "path": None, "n_rows": None, "x": 1}])]), ("x",)))


def test_one_doc_id_may_lie_in_many_blocks(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    data = [(7, f"{passage} x{i} {passage}") for i in range(40)] + [(8, f"y {passage}"), (9, passage)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = substrings.find_repeats(docs, block_bytes=300, group_suffixes=50).collect()
    assert sorted((False, x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == by_hand(data)


def test_words_decide_where_fingerprints_agree():
    texts = [f"a b c d e f g h i j k l m{i % 3} n o p q r s t u v w x y" for i in range(6)]
    block = substrings.Block(iter([(pa.array(range(6)), pa.array(texts))]))
    windows, starts = block.nodes(np.zeros(len(block.at), np.uint64))
    found = sorted(sorted(w.tolist()) for w in np.split(windows, starts[1:]))
    same = {}
    words = [w for t in texts for w in t.split()]
    for i, at in enumerate(block.at):
        same.setdefault(tuple(words[at : at + 13]), []).append(i)
    assert found == sorted(same.values())


def test_the_tree_of_sorted_suffixes():
    r = np.random.default_rng(2)
    suffixes = r.integers(0, 3, (500, 4)).astype(np.int32)
    order, shared = substrings.subtree(suffixes)
    ordered = suffixes[order].tolist()
    assert ordered == sorted(suffixes.tolist())
    assert shared.tolist() == [0] + [next((k for k in range(4) if a[k] != b[k]), 4) for a, b in zip(ordered, ordered[1:], strict=False)]


def test_nothing(spark):
    assert substrings.find_repeats(spark.createDataFrame([], DOCS)).collect() == []
    assert substrings.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_packing_of_sorted_values():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    assert (substrings.unpacked(substrings.packed(values)) == values).all()
    assert len(substrings.unpacked(substrings.packed(values[:0]))) == 0


def test_common_words_are_counted_by_range_not_row_by_row(spark, monkeypatch):
    """Every word of a short block is common in it: rows for the counting grow with ranges, not with blocks times words."""
    blocks, ranges = 40, 3
    texts = [" ".join([f"w{i}" for i in range(300)] + [f"own{b}x{i}" for i in range(50)] + ["half"] * (b % 2)) for b in range(blocks)] + [None]
    batches = [pa.RecordBatch.from_pydict({"id": [b], "text": pa.array([t], pa.string()), "block": pa.array([b], pa.int64())}) for b, t in enumerate(texts)]
    sent = [r for b in substrings._printer(40, ranges)(iter(batches)) for r in b.to_pylist()]
    assert len(sent) <= ranges * blocks
    table = pa.Table.from_pylist(sorted(sent, key=lambda r: (r["grp"], r["block"])))
    found = [r for b in substrings._matcher(blocks)(iter(table.to_batches())) for r in b.to_pylist() if r["common"] is not None]
    assert len(found) <= ranges
    words = {int(substrings.xxhash.xxh64_intdigest(f"w{i}")) for i in range(300)}
    assert {int(x) for r in found for x in substrings.unpacked(r["common"])} == words  # "half" is in half of them, no more

    def explode(*_):
        raise AssertionError("a row for each block and common word")

    monkeypatch.setattr(substrings.F, "explode", explode)
    data = [(d, " ".join(f"w{i}" for i in range(d, d + 30))) for d in range(60)]
    got = substrings.find_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(7), block_bytes=200).collect()
    assert sorted((False, x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == by_hand(data)


@pytest.mark.parametrize("rare, most", [(1, 0.2), (2, 0.4)])
def test_suffixes_that_begin_near_each_other_are_in_one_group(rare, most):
    """So that a passage isn't sent again for every word that isn't common (before: a group for each, 13 words a suffix)."""
    r = np.random.default_rng(3)
    hashes = np.unique(r.integers(1, 1 << 63, 6000, np.uint64))[:5000]
    number, common = r.integers(0, 5000, 5013).astype(np.int32), np.zeros(5000, bool)
    suffixes = np.lib.stride_tricks.sliding_window_view(number, substrings.WINDOW)
    groups = substrings.prefix_groups(suffixes, hashes, common, rare, 1 << 30)
    assert (groups[1:] != groups[:-1]).mean() < most
    # A group is of the words alone: not of their numbers in a block, nor of what else is in it.
    other = r.permutation(5000)
    place = np.argsort(other)
    some = r.permutation(len(suffixes))[:700]
    assert (substrings.prefix_groups(place[suffixes[some]].astype(np.int32), hashes[other], common, rare, 1 << 30) == groups[some]).all()
    common[:] = True  # nothing but common words: by all of them
    whole = substrings.prefix_groups(suffixes, hashes, common, rare, 1 << 30)
    assert len(np.unique(whole)) > 0.99 * len(np.unique(suffixes, axis=0))


def test_sorted_words_without_what_they_share():
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"ab\xc3\x00") for _ in range(r.randint(1, 30))) for _ in range(3000)} | {b"a" * n for n in (1, 2, 300, 70000)})
    given = pa.array(words, pa.large_binary())
    for some in (given, given.slice(5, 700), given.slice(9, 1), given.take(pa.array(range(0, len(words), 3)))):
        raw = substrings._fronted(some)
        assert substrings._unfronted(raw, len(some)).to_pylist() == some.to_pylist()
    assert substrings._unfronted(substrings._fronted(given[:0]), 0).to_pylist() == []
    near = pa.array([f"internationali{i:05}" for i in range(5000)], pa.large_string())
    assert int.from_bytes(substrings._fronted(near)[:8], "little") < 0.6 * (4 + 19) * len(near)
