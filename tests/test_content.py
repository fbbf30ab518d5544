"""The main content of pages, fetching, admission: hand-written expectations."""

import hashlib

from lontar import vocab
from lontar.operators.html import main_content, main_text, page_text, visible_text
from lontar.sources import fetch, storage

PAGE = """<html><head><title>Caf&eacute;</title><style>p {}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul><nav>inner</nav> menu left over</nav>
<div><a href="/x">one two three four five six seven eight nine ten</a></div>
<h1>A title</h1><p>The first paragraph has more than eight words, &#8220;really&#8221; &#xE9;.</p>
<h2>Between</h2><p>The second <b>paragraph</b> has <a href="/y">one link</a> and enough words too.</p>
<table><tr><td>cells of a table hold figures and not running text here</td></tr></table>
<aside>an aside <footer>with</footer> words</aside><p>Short.</p><script>if (a < b) {}</script></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "The first paragraph has more than eight words, “really” é.",
        "Between",
        "The second paragraph has one link and enough words too.",
    ]
    assert main_text("<p>Few words &amp; more</p><div>x</div>") == "Few words & more x"
    assert main_text("") == "" and main_text("<nav>a") == ""


def test_visible_text_minds_nesting_and_entities():
    text = visible_text(PAGE)
    for hidden in ("Home", "inner", "left over", "aside", "with", "if ("):
        assert hidden not in text
    assert "Café" in text and "“really” é" in text and "Short." in text
    assert visible_text("<p>a<nav>b<nav>c</nav>d</nav>e</p>").split() == ["a", "e"]


def test_columns(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None)], "n int, html string")
    got = {r.n: (r.m, r.v) for r in rows.select("n", main_content("html").alias("m"), page_text("html").alias("v")).collect()}
    assert got == {1: (main_text(PAGE), visible_text(PAGE)), 2: ("", "")}


def test_fetching_from_a_folder(spark, tmp_path):
    (tmp_path / hashlib.sha1(b"https://a.example/").hexdigest()).write_text("<p>é</p>")
    tasks = spark.createDataFrame([("https://a.example/",), ("https://b.example/",), (None,)], "url string")
    got = {r.url: (r.status, r.html, r.user_agent in vocab.USER_AGENTS) for r in fetch.scan_http(tasks, fetch.FolderFetcher(tmp_path.as_uri())).collect()}
    assert got == {"https://a.example/": (200, "<p>é</p>", True), "https://b.example/": (404, None, True)}
    bad = fetch.scan_http(tasks, lambda url, agent: 1 / 0)
    assert {r.status for r in bad.collect()} == {0}


def test_admission(spark):
    tasks = spark.createDataFrame([(i, f"d{i % 3}") for i in range(30)], "n int, domain string")
    running = spark.createDataFrame([("d0",), ("d0",), ("other",)], "domain string")
    got = sorted(r.n for r in fetch.admitted(tasks, "n", running, all_at_once=9, per_domain=4).collect() if r.admitted)
    assert got == [0, 1, 2, 3, 4, 5]  # six are free; d0 has two left
    assert sorted(r.n for r in fetch.admitted(tasks, "n", running, per_domain=4).collect() if r.admitted) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11]


def test_rejected_rows_keep_what_is_null(spark):
    from lontar.operators import corpus

    rows = spark.createDataFrame([("s", "A", "b", "c", None, None), ("t", "A", "b", "c", "u, {v}", "de")], "sentence string, religion string, source string, region string, url string, detected_lang string")
    assert [(r.Link, r.Detected_Language) for r in corpus.map_rejected(rows).collect()] == [("", "unknown"), ("u, {v}", "de")]


def test_drain(spark, tmp_path):
    storage.write_lines(spark.createDataFrame([("a",)], "value string"), f"{tmp_path}/buffer")
    taken = storage.drain(spark, f"{tmp_path}/buffer", f"{tmp_path}/drained")
    assert [r.value for r in spark.read.text(taken).collect()] == ["a"] and not (tmp_path / "buffer").exists()
    assert storage.drain(spark, f"{tmp_path}/buffer", f"{tmp_path}/drained") is None
