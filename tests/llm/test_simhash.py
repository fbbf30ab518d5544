import random

import pytest
import xxhash

from lontar.llm.components import components
from lontar.llm.simhash import fingerprint, near_duplicates, near_links

DOCS = "doc_id long, text string, fp string, u long"


def by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = " ".join(r.choice(["Äh", "The", "of", "AND", "x" * 30]) for _ in range(n)) + "\x1c  \n"
        assert fingerprint(text.encode()) == by_hand(text)
    assert fingerprint(b" \n\t") == 0


@pytest.mark.parametrize("group", [40, 100_000])
def test_links_against_all_pairs(spark, group):
    r = random.Random(group)
    seen = [r.getrandbits(64) for _ in range(120)]
    seen += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in seen * 2] + [0, 3, 7, (1 << 64) - 1]
    seen += [x ^ (1 << r.randrange(64)) for x in seen[-60:]]
    seen = sorted(set(seen))
    want = roots(len(seen), [(i, j) for i in range(len(seen)) for j in range(i) if (seen[i] ^ seen[j]).bit_count() <= 2])
    signed = [x - (1 << 64) if x >> 63 else x for x in seen]
    links = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=group).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert roots(len(seen), [(at[a], at[b]) for a, b in links]) == want


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)] + [(7, 300 + i) for i in range(50)] + [(r.randrange(200, 290), r.randrange(200, 290)) for _ in range(40)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links * 2, "u long, v long")).collect()}
    want = roots(400, links)
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(3, "a b c"), (1, None), (2, " \n"), (9, "A  b\tc"), (9, "A  b\tc"), (None, "a b c"), (4, long), (8, long + " x"), (None, "other words here"), (6, "")]
    got = near_duplicates(spark.createDataFrame([(*x, "clash", 1) for x in rows], DOCS)).collect()
    assert len(got) == len(rows)
    prints = [by_hand(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    first = [min((rows[j][0] for j in range(len(rows)) if want[j] == want[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted([(x.doc_id, x.fp % (1 << 64), x.component_id) for x in got], key=key) == sorted(zip([d for d, _ in rows], prints, first), key=key)
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
