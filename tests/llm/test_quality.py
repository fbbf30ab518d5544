import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lontar.llm import quality, shared

DOCS = "doc_id long, text string, source string, kept int, host string, n_words string"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "é", "#", "\n", "c d ", "\x1c", "  "]) for _ in range(r.randint(0, 60)))
        assert quality.measure(text.encode()) == by_hand(text)
    assert quality.measure(b"") == (0, 0, 0, 0, 0)
    assert quality.measure(("x y z " * 40_000).encode())[4] == 120_000


def data():
    r = random.Random(2)
    good = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    out = [(i, good() if i % 4 else "short", f"h{i % 5}") for i in range(60)]
    out += [(100 + i, "same words here " * 30 if i < 29 else good(), "bad") for i in range(30)]
    return out + [(200, None, "h1"), (201, "", None), (None, good(), None), (202, good(), "single"), out[3], out[3]]


def verdicts(rows):
    """Refused hosts, by the formulas in plain Python."""
    hosts = defaultdict(list)
    for _, text, host in rows:
        n, chars, symbols, dup, repeated = by_hand(text)
        if host is not None:
            hosts[host].append((n < 50 or 100 * repeated > 50 * n, 10 * symbols > chars, 50 * dup > max(n, 1)))
    refused = set()
    for k in range(3):
        n, k_hosts = sum(map(len, hosts.values())), len(hosts)
        m = sum(x[k] for f in hosts.values() for x in f) / n
        apart = sum(len(f) * (sum(x[k] for x in f) / len(f) - m) ** 2 for f in hosts.values())
        free = n - sum(len(f) ** 2 for f in hosts.values()) / n - (k_hosts - 1)
        c = (apart / (m * (1 - m)) - (k_hosts - 1)) / free if 0 < m < 1 and free > 0 else 0
        s = 1 / min(max(c, 1e-6), 0.99) - 1
        refused |= {h for h, f in hosts.items() if (sum(x[k] for x in f) + m * s) / (len(f) + s) > 0.5}
    return refused


@pytest.mark.parametrize("limit", [200_000, 0])
def test_verdicts(spark, limit, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)  # both ways of joining hosts
    rows = data()
    refused = verdicts(rows)
    assert refused == {"bad"}
    docs = spark.createDataFrame([(*x, 1, "clash", "clash") for x in rows], DOCS).repartition(3)
    want = []
    for d, text, host in rows:
        f = by_hand(text)
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        want.append((d, *f, failed, host in refused, not failed and host not in refused))
    got = [tuple(x) for x in quality.quality_rules(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = quality.keep_good(docs).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept) == sorted((w[0] is None, w[0] or 0) for w in want if w[-1])
    assert all(x.host == "clash" and x.kept == 1 for x in kept)


def test_chance_in_small_hosts_is_not_taken_for_a_difference(spark):
    r = random.Random(7)
    rows = [(i, 10, 0, 0, 0, 0, f"one{i}") if r.random() < 0.4 else (i, 60, 0, 0, 0, 0, f"one{i}") for i in range(2000)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, host string")
    assert quality.host_verdicts(table(rows)).filter("host_refused").count() == 0
    # A few large hosts that differ: the large ones are judged by themselves, one document says little.
    for h, rate in enumerate((0.05, 0.1, 0.9, 0.1, 0.05)):
        rows += [(9000, 10 if r.random() < rate else 60, 0, 0, 0, 0, f"large{h}") for _ in range(300)]
    refused = {x.host for x in quality.host_verdicts(table(rows)).filter("host_refused").collect()}
    assert "large2" in refused and not refused & {"large0", "large1", "large3", "large4"}
    m, s = quality.beta_prior(4, 40.0, 400.0, 20.0, sum(x * x / 10 for x in (1, 9, 2, 8)))
    assert m == 0.5 and 0.5 < s < 5


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_rules(empty).collect() == [] and quality.keep_good(empty).collect() == []
    one = spark.createDataFrame([(1, "a b", "h", 0, "", "")], DOCS)
    assert quality.quality_rules(one).select(F.col("kept")).first()[0] is False
