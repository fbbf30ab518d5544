import random
import re
from array import array
from collections import defaultdict
from zlib import crc32

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_pii import by_hand as base_spans  # noqa: E402
from test_simhash import by_hand as fingerprint  # noqa: E402
from test_simhash import roots  # noqa: E402

from lontar.llm import pii, quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    r = random.Random(8)
    words = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for d in range(90):
        text = " ".join(r.choice(words) for _ in range(r.choice([5, 49, 50, 80, 300])))
        if d % 5 == 0:
            text += f" {passage} " + " ".join(r.choice(words) for _ in range(60))
        if d % 7 == 0:
            text += f" mail a{d}.b@{r.choice(words)}.com now\nor +1 (269) 555-{1000 + d} then"
        out.append((d, text, "en", f"s{d % 6}", len(text)))
    for d in range(90, 120):
        out.append((d, out[r.randrange(90)][1] + r.choice(["", "", "."]), "en", "copies", 0))
    for d in range(120, 140):  # a host of failures takes its good documents with it
        out.append((d, "spam spam spam " * 40 if d < 139 else " ".join(r.choice(words) for _ in range(90)), "en", "bad", 0))
    out += [(140, None, "en", "s1", 0), (141, "", "en", None, 0), (142, out[3][1] * 30, "en", None, 0), out[4], out[4]]
    r.shuffle(out)
    return out


def words(text):
    return SPLIT.findall(text or "")


def test_stages_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    run = {name: f for name, f in corpus_pipeline.STAGES}
    key = lambda rs: sorted([tuple(x) for x in rs], key=repr)

    fails = defaultdict(list)
    own = {}
    for x in rows:
        w = words(x[1])
        grams = defaultdict(int)
        for i in range(len(w) - 2):
            grams[tuple(w[i : i + 3])] += 1
        repeated = sum(any(grams.get(tuple(w[j : j + 3]), 0) > 1 for j in range(max(0, i - 2), i + 1)) for i in range(len(w)))
        own[x] = len(w) < 50 or 100 * repeated > 50 * len(w)
        if x[3] is not None:
            fails[x[3]].append(own[x])
    rates = [sum(f) / len(f) for f in fails.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    k = min(max(m * (1 - m) / v - 1, 1.0), 1e6)
    refused = {h for h, f in fails.items() if (sum(f) + m * k) / (len(f) + k) > quality.HOST_RATES["base"]}
    assert refused == {"bad"}
    want = [x for x in rows if not own[x] and x[3] not in refused]
    good = run["quality"](spark, docs, "").collect()
    assert key(good) == key(want) and 60 < len(want) < 130

    prints = [fingerprint(x[1]) for x in want]
    root = roots(len(want), [(i, j) for i in range(len(want)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    first = {}
    for i, x in enumerate(want):
        first[root[i]] = min(first.get(root[i], x), x, key=lambda y: y[0])
    one = run["near_duplicates"](spark, spark.createDataFrame(good, DOCS), "").collect()
    assert key(one) == key(first.values()) and len(one) < len(good) - 5

    least = {}
    for x in one:
        w = words(x[1])
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(x[0], least.get(tuple(w[i : i + 13]), x[0]))
    left = {}
    for x in one:
        w = words(x[1])
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < x[0] for j in range(i, i + 13)}
        left[x[0]] = [y for i, y in enumerate(w) if i not in gone]
    cut = run["repeated_passages"](spark, spark.createDataFrame(one, DOCS), "").collect()
    assert {x[0]: words(x[1]) for x in cut} == left and all(x[4] == len(x[1]) for x in cut)
    assert any(len(left[x[0]]) < len(words(x[1])) for x in one)

    clean = run["personal_data"](spark, spark.createDataFrame(cut, DOCS), "").collect()
    by_id = {x[0]: x for x in clean}
    assert len(clean) == len(cut)
    for x in cut:
        spans = base_spans(x[1])
        assert set(spans) <= set(pii.spans_of(x[1], pii.Scores(pii.trained()))[1])
        assert not base_spans(by_id[x[0]][1])
        if not spans and not re.search("[0-9@]", x[1]):
            assert tuple(by_id[x[0]]) == tuple(x)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = run["packing"](spark, spark.createDataFrame(clean, DOCS), "").collect()
    ids = {x[0]: [*tokenizer.encode(x[1], add_special_tokens=False).ids, 1] for x in clean}
    seen = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == seen[p.doc_id] and p.ids_crc32 == crc32(array("I", ids[p.doc_id][p.start : p.start + p.length]).tobytes())
        seen[p.doc_id] += p.length
    assert seen == {d: len(i) for d, i in ids.items()}


def test_run_is_the_stages_and_empty_tables_pass(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, "").collect(), f(spark, docs, "").schema)
    columns = ("doc_id", "start", "doc_tokens")  # cuts depend on how rows are dealt to tasks
    at_once = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert {(x.doc_id, x.doc_tokens) for x in at_once.select(*columns).collect()} == {(x.doc_id, x.doc_tokens) for x in docs.select(*columns).collect()}
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
