"""Operators whose results a few rows show."""

import pytest
from pyspark.sql import functions as F

from lontar import ml, vocab
from lontar.functions import urls
from lontar.functions.text import barrier
from lontar.operators import corpus, dedup, frontier, html, language, ratelimit
from lontar.plans import extract
from lontar.sources import storage
from lontar.streaming import pages as streams


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [("https://a.id/x/#top", "https://a.id/x"), ("https://a.id/x?utm_source=q&b=1", "https://a.id/x&b=1"), ("https://a.id/x/?ref=q", "https://a.id/x/"), ("https://a.id//", "https://a.id")],
)
def test_url_normalize(spark, url, want):
    assert one(spark, url, urls.url_normalize) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.id/news/news/1", True), ("https://a.id/a/b/c/d/e/f/g", True), ("https://a.id/x?f=a.pdf", False), ("https://a.id/X.PDF", True), ("https://a.id/2020/01/02/2020/x", True),
        ("https://a.id/feed", True), ("https://a.id/News/news", False), ("https://a.id", False),
    ],
)
def test_url_trap(spark, url, want):
    assert one(spark, url, urls.url_trap) == want


def test_urls_of_all_kinds(spark):
    hrefs = {"x": "https://a.id/d/x", "/x": "https://a.id/x", "//b.id/x": "https://b.id/x", "?q=1": "https://a.id/d/p?q=1", "http://c.id": "http://c.id"}
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    assert {r[0]: r[1] for r in df.select("h", urls.url_resolve(F.col("h"), F.lit("https://a.id/d/p?z#y"))).collect()} == hrefs
    assert one(spark, "https://User@a.ID:80/x?y", urls.url_domain) == "User@a.ID:80"
    assert one(spark, "no url", urls.url_domain) == ""


def test_links(spark):
    page = "<a href='/a'>x</a><A HREF=\"mailto:x\"><a href='https://sub.a.id/b#c'><a href='https://nota.id/'><a href='/f.pdf'><a href='/a'>"
    got = frontier.extract_links(spark.createDataFrame([("https://a.id/p", page), ("https://b.id", None)], "url string, html string")).collect()
    assert sorted(x.link for x in got) == ["https://a.id/a", "https://sub.a.id/b"]


def test_initials():
    cases = {
        '<span class="dropcap">H</span>ati': "Hati",
        '<span style="float:left; font-size:3em">Ma</span>sjid': "Masjid",
        '<div class="first-letter">H</div>omili': "Homili",
        "<p><b>H</b>ati</p>": "<p>Hati</p>",
        "<b>Hati</b> ku": "<b>Hati</b> ku",
        "<b>a</b>bc": "<b>a</b>bc",
        "<b>H</b> <i>x</i> &amp; y": "<b>H</b> <i>x</i> &amp; y",
    }
    for page, want in cases.items():
        assert html.join_initials(page) == want


def test_html_columns(spark):
    page = '<span class="dropcap">H</span>ati<script>var x="</p>";</script><nav>n</nav><!-- c --><p>a&amp;lt;</p><input type=x>b'
    assert one(spark, page, html.dropcap_html_regex).startswith("Hati<script>")
    assert " ".join(one(spark, page, html.fallback_text).split()) == "H ati a&lt; b"
    df = spark.createDataFrame([('<b>H</b>ati',), (None,)], "h string")
    assert [x[0] for x in df.select(html.dropcap_html("h")).collect()] == ["Hati", None]
    assert one(spark, None, html.fallback_text) == ""


def test_rate_limits(spark):
    events = [("a", i, float(i), 200) for i in range(10)] + [("b", 1, 0.0, 429), ("b", 2, 1.0, 200), ("b", 3, 61.0, 200), ("c", 1, 0.0, 500)] + [("d", i, 0.0, 500) for i in range(40)]
    df = spark.createDataFrame(events, "domain string, seq long, t double, status int")
    got = {x.domain: x for x in ratelimit.rate_limit_fold(df, "domain", "t", "status", "seq").collect()}
    assert got["a"].adaptive_delay == pytest.approx(0.01875 * 0.95) and got["a"].status == "active"
    assert (got["b"].status, got["b"].extra_delay, got["b"].cooldown_until) == ("slowed", 5.0, 60.0)
    assert got["c"].adaptive_delay == pytest.approx(0.028125) and got["d"].adaptive_delay == 2.0
    report = {x.domain: x for x in ratelimit.domain_report(ratelimit.rate_limit_fold(df, "domain", "t", "status", "seq"), F.lit(30.0)).collect()}
    assert report["b"].cooling_down and report["b"].cooldown_remaining == 30.0 and not report["a"].slowed


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 2], [0, 1, 1, 1], strict=True)), "label int, prediction int")
    matrix = corpus.confusion_matrix(df, "label", "prediction", [0, 1, 2])
    assert matrix.count() == 9 and matrix.agg(F.sum("n")).first()[0] == 4
    m = corpus.weighted_prf(matrix).first()
    assert m.accuracy == 0.5 and m.recall == 0.5 and m.precision == pytest.approx(0.5 * 1 + 0.25 / 3)
    counters = spark.createDataFrame([(0, 0, 0, 0, 0)], "sites long, sentences long, failed long, duplicates long, queue long")
    none = ratelimit.crawl_metrics(counters, F.lit(0.0), F.lit(0.0)).first()
    assert none.progress_percent == 0.0 and none.urls_per_minute == 0.0


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[min(2, i // 10)]) for i in range(100)], "id long, label string")
    balanced = corpus.balance(df, "label", "id")
    assert {x["label"]: x["count"] for x in balanced.groupBy("label").count().collect()} == {"a": 10, "b": 10, "c": 10}
    assert sorted(balanced.collect()) == sorted(corpus.balance(df.repartition(5), "label", "id").collect())
    split = corpus.stratified_split(df, "label", "id")
    assert split.count() == 100 and split.filter("split = 'test'").count() == 1 + 1 + 8
    assert corpus.balance(df.limit(0), "label", "id").count() == 0
    labels = corpus.label_ids(spark.createDataFrame([("Islam",), ("x",), (None,)], "Label string")).collect()
    assert [x.label for x in labels] == [0]


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "page_id long, html string")
    once = dedup.content_dedup(df)
    assert sorted(x.page_id for x in once.collect()) == [1, 2, 4, 5]
    assert sorted(dedup.content_dedup(once).collect(), key=repr) == sorted(once.collect(), key=repr)
    s = spark.createDataFrame([("u", "x", 1), ("u", "x", 0), ("v", "x", 2)], "url string, sentence string, position int")
    assert sorted((x.url, x.position) for x in dedup.sentence_dedup(s).collect()) == [("u", 0), ("v", 2)]
    kept, rejected = dedup.route(s.withColumn("is_target", F.when(F.col("url") == "v", False)))
    assert kept.count() == 2 and rejected.count() == 1


def test_language(spark):
    assert one(spark, "the cat and the dog of the house", language.detect_language) == "en"
    assert one(spark, "xyz", language.detect_language) == "unknown"
    target, lang = language.gate(F.col("t"), F.lit("id"))
    assert one(spark, "pendek", lambda _: lang) == "too_short" and not one(spark, "pendek", lambda _: target)
    assert one(spark, "cukup panjang untuk ini", lambda _: target)


def test_barrier_computes_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    made = barrier(df, t=F.regexp_replace("t", "0", "x")).filter((F.col("t") != "a") & (F.length("t") > 0)).withColumn("u", F.concat("t", "t"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [x.u for x in made.collect()] == ["xx", "11", "22"]


def test_extraction(spark):
    text = "Mereka berjalan bersama menuju kota lama setiap pagi hari. Tapi mereka pulang. Mereka membaca beritaPOST setiap pagi hari bersama keluarga."
    docs = spark.createDataFrame([(1, text, "id"), (2, None, "id"), (3, text, "en")], "doc_id long, text string, lang string")
    got = extract.extract_sentences(docs, F.col("lang")).collect()
    assert [(x.doc_id, x.is_target) for x in got] == [(1, True), (3, False)]
    assert extract.judged(extract.sentences(extract.cleaned(docs))).count() == 6
    assert extract.target_sentences(docs, F.col("lang")).count() == 1


def test_state_files(spark, tmp_path):
    path = tmp_path.as_uri()
    (tmp_path / "queue.json").write_text('[{"url": "u1", "depth": 2, "domain": "d"}, {"url": "u2"}]')
    visited = spark.createDataFrame([("u2",)], "url string")
    assert [x.url for x in storage.read_queue(spark, f"{path}/queue.json", visited, one_array=True).collect()] == ["u1"]
    (tmp_path / "broken.json").write_text("[{")
    assert storage.read_queue(spark, f"{path}/broken.json", one_array=True).count() == 0
    (tmp_path / "seeds.json").write_text('{"islam": [{"url": "https://a.id/x", "source": "S"}], "catholic": []}')
    (seed,) = frontier.seed_tasks(storage.read_seeds(spark, f"{path}/seeds.json")).collect()
    assert (seed.religion, seed.source, seed.region, seed.domain, seed.depth) == ("Islam", "S", "Unknown", "a.id", 0)
    for name in ("c_1.csv", "c_2.csv"):
        (tmp_path / name).write_text("x")
    assert storage.latest_file(spark, f"{path}/c_*.csv").endswith("c_2.csv") and storage.latest_file(spark, f"{path}/z*", "none") == "none"
    assert storage.archive(spark, f"{path}/c_1.csv", f"{path}/old").endswith("old/c_1.csv")
    (tmp_path / "c_1.csv").write_text("y")
    assert storage.archive(spark, f"{path}/c_1.csv", f"{path}/old").endswith("old/c_1.csv.1")
    assert storage.archive(spark, f"{path}/c_1.csv", f"{path}/old") is None


def test_corpus_csv_round_trip(spark, tmp_path):
    rows = [("Islam", "s", "r", "", "", 'a "quoted", line\nand more \\ x', "u"), ("Catholic", "", "", "", "", "é", "")]
    df = spark.createDataFrame(rows, storage.CORPUS_SCHEMA)
    storage.write_corpus(df, f"{tmp_path}/c")
    storage.write_corpus(df, f"{tmp_path}/c")
    assert sorted(storage.read_corpus(spark, f"{tmp_path}/c").collect()) == sorted(rows * 2)


def test_stream_survives_a_restart(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = lambda *ids: spark.createDataFrame([(i, f"h{i % 4}") for i in ids], "page_id long, html string")
    for ids in ((0, 1, 2), (4, 3, 7)):
        rows(*ids).coalesce(1).write.mode("append").parquet(source)
        stream = streams.content_dedup(spark.readStream.schema("page_id long, html string").parquet(source))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.html for x in spark.read.parquet(f"{tmp_path}/out").collect()) == ["h0", "h1", "h2", "h3"]


def test_classifier(spark, tmp_path):
    rows = [(f"kata {w} {i}", w, y) for i in range(20) for w, y in (("satu", 0), ("dua", 1), ("tiga", 2))]
    df = spark.createDataFrame(rows, "Sentence_Unit string, w string, label int")
    model = ml.train(df, iterations=5)
    got = ml.classify(model, df.limit(9).union(spark.createDataFrame([(None, "x", 0)], df.schema)), vocab.LABELS).collect()
    assert all(abs(sum(x.probabilities.values()) - 1) < 1e-9 and x.confidence == max(x.probabilities.values()) for x in got)
    assert [x.predicted for x in got[:3]] == ["Islam", "Catholic", "Protestant"]
    ml.save(model, f"{tmp_path}/m", vocab.LABELS, {"max_length": ml.MAX_TOKENS})
    assert spark.read.text(f"{tmp_path}/m/label_map").first()[0] == '{"Islam": 0, "Catholic": 1, "Protestant": 2}'
