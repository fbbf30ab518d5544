"""Crawls over chains of links that are longer than the depth bound."""

import pytest

from lontar import vocab
from lontar.operators import frontier
from lontar.plans.queries import QUERIES
from lontar.sources import storage


@pytest.fixture
def folder(spark, tmp_path):
    """Page n links to page n + 1, and pages 3, 13, ... also to a page that has not been fetched."""
    url = lambda n: f"https://example.com/p{n}"
    html = lambda n: f'<a href="{url(n + 1)}">' + (f'<a href="{url(900 + n)}">' if n % 10 == 3 else "")
    rows = [(n, url(n), html(n)) for n in range(1, 31) if n != 29]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path), {url(n): [url(n + 1), *([url(900 + n)] if n % 10 == 3 else [])] for n, _, _ in rows}, [(n, u) for n, u, _ in rows]


def by_hand(seeds, links):
    depth = dict.fromkeys(seeds, 0)
    level = list(depth)
    for d in range(1, vocab.MAX_DEPTH + 1):
        level = [u for u in dict.fromkeys(v for x in level for v in links.get(x, [])) if u not in depth]
        depth |= dict.fromkeys(level, d)
    return depth


def test_whole_depth(spark, folder):
    path, links, pages = folder
    assert {r.url: r.depth for r in QUERIES["crawl_levels"](spark, path).collect()} == by_hand([u for _, u in pages], links)


def test_depth_bound(spark, folder):
    path, links, pages = folder
    storage.work_folder(spark, "levels")
    table = spark.read.parquet(f"{path}/pages.parquet")
    wanted = by_hand([u for n, u in pages if n % 10 == 0], links)
    got = frontier.crawl(table.filter("page_id % 10 = 0").select("url"), frontier.extract_links(table))
    assert {r.url: r.depth for r in got.collect()} == wanted and max(wanted.values()) == vocab.MAX_DEPTH


def test_turns_of_a_large_domain(spark):
    storage.work_folder(spark, "turns")
    rows = [(i * 37 % 501, "big" if i % 10 else f"d{i}") for i in range(501)] + [(900, None), (901, None)]
    got = frontier.round_robin(spark.createDataFrame(rows, "n long, domain string").repartition(3), "n").collect()
    wanted = {n: 1 + sum(1 for m, d in rows if d == own and m < n) for n, own in rows}
    assert {x.n: x.turn for x in got} == wanted
