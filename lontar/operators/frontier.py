"""The frontier of a crawl: links of pages, what is visited, what comes next.

A frontier is a frame of tasks (url, depth, religion, source, region, domain); all set operations are anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import matches
from ..functions.urls import url_domain, url_normalize, url_resolve, url_same_domain, url_trap

TASK = ["url", "depth", "religion", "source", "region", "domain"]


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, link: each page's links within its own domain, normalized, once each."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)))
    found = pages.select(F.col(url).alias("url"), href.alias("href"))
    skipped = F.lit(False)
    for scheme in vocab.SKIPPED_SCHEMES:
        skipped = skipped | F.startswith("href", F.lit(scheme))
    links = found.filter(~skipped).select("url", url_normalize(url_resolve(F.col("href"), F.col("url"))).alias("link"))
    return links.filter(url_same_domain(F.col("link"), url_domain(F.col("url"))) & ~url_trap(F.col("link"))).distinct()


def seed_tasks(seeds: DataFrame) -> DataFrame:
    """Tasks of a seed table with one map column ``seeds``: class to its sites."""
    sites = seeds.select(F.explode("seeds").alias("class", "sites")).select("class", F.explode("sites").alias("site"))
    name = F.concat(F.upper(F.substring("class", 1, 1)), F.lower(F.substring("class", 2, 1_000)))
    unknown = F.lit("Unknown")
    return sites.select(
        F.col("site.url").alias("url"), F.lit(0).alias("depth"), name.alias("religion"), F.coalesce("site.source", unknown).alias("source"), F.coalesce("site.region", unknown).alias("region"), url_domain(F.col("site.url")).alias("domain")
    )


def unvisited(tasks: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    return tasks.join(visited.select(url).distinct(), url, "left_anti")


def expand(tasks: DataFrame, links: DataFrame, visited: DataFrame) -> DataFrame:
    """The tasks that the pages of tasks lead to: a level deeper, with all else inherited; visited links are left out."""
    parents = tasks.filter(F.col("depth") < vocab.MAX_DEPTH)
    children = parents.join(links, "url").select(F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), "religion", "source", "region", "domain", F.col("url").alias("discovered_from"))
    return unvisited(children, visited)


def crawl(tasks: DataFrame, links: DataFrame, levels: int = vocab.MAX_DEPTH) -> DataFrame:
    """url, depth: every page reachable from the tasks with the least depth, level by level.

    Each level is checkpointed, so that nothing is done twice; what has been seen is the levels together, never written again."""
    seen = level = tasks.select("url", F.lit(0).alias("depth")).distinct()
    for depth in range(1, levels + 1):
        level = unvisited(level.join(links, "url").select(F.col("link").alias("url")).distinct(), seen).withColumn("depth", F.lit(depth))
        level = level.checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def boundary(children: DataFrame) -> DataFrame:
    """Children at the last level, once per URL: the first page (by URL) that leads to one counts."""
    at_end = children.filter(F.col("depth") == vocab.MAX_DEPTH)
    first = F.row_number().over(Window.partitionBy("url").orderBy("discovered_from", "religion", "source"))
    return at_end.withColumn("_n", first).filter("_n = 1").drop("_n", "depth")


def boundary_to_seeds(boundary_urls: DataFrame, visited: DataFrame, seeds: DataFrame) -> DataFrame:
    """Boundary entries that are neither visited nor seeds of their class, as new seeds (class, url, source, region)."""
    entries = boundary_urls.select(F.lower("religion").alias("class"), "url", F.coalesce("source", F.lit("Depth_Boundary")).alias("source"), F.coalesce("region", F.lit("Unknown")).alias("region"))
    return unvisited(entries, visited).join(seeds.select("class", "url").distinct(), ["class", "url"], "left_anti").dropDuplicates(["class", "url"])


def domain_cap(pages: DataFrame, order: str, cap: int = vocab.DOMAIN_CAP, domain: str = "domain") -> DataFrame:
    """At most cap pages of a domain, in order; 0 sets no limit. The rank is cut off in the map tasks."""
    if not cap:
        return pages
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(order))).filter(F.col("_n") <= cap).drop("_n")


def round_robin(tasks: DataFrame, order: str, domain: str = "domain") -> DataFrame:
    """turn: in which round a task's domain, which serves its tasks in order, comes to it.

    Tasks are dealt by ranges of domain and order; a turn is what a domain has in lower ranges plus the place within one. So a
    large domain isn't sorted in one task: what is gathered by domain is a count for each range."""
    dealt = tasks.repartitionByRange(domain, order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(F.col(domain).alias("_domain"), F.col("_range").alias("_r")).agg(F.count("*").alias("_k"))
    before = counts.select("_domain", "_r", (F.sum("_k").over(Window.partitionBy("_domain").orderBy("_r")) - F.col("_k")).alias("_before"))
    joined = dealt.join(before, dealt[domain].eqNullSafe(before["_domain"]) & (dealt["_range"] == before["_r"]))
    within = F.row_number().over(Window.partitionBy("_domain", "_r").orderBy(order))
    return joined.select(*tasks.columns, (F.col("_before") + within).cast("int").alias("turn"))


def fetch_accept(status: Column, content_type: Column) -> Column:
    return (status == 200) & F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html"))


def min_content(html: Column) -> Column:
    return F.coalesce(F.length(html), F.lit(0)) >= vocab.MIN_HTML


def retry_decision(status: Column, retries: Column) -> Column:
    """requeue, or drop once the retries are used; done where there was no refusal."""
    refused = status.isin(429, 503)
    return F.when(refused & (retries < vocab.MAX_RETRIES), "requeue").when(refused, "drop").otherwise("done")


def robots_allows(rules: Column, path: Column) -> Column:
    """Whether the Disallow lines for all agents (an array of path prefixes) leave a path open; none leave all open."""
    return ~F.exists(F.coalesce(rules, F.array().cast("array<string>")), lambda r: (r != "") & F.startswith(path, r))


def is_link(href: Column) -> Column:
    return matches(href, r"^https?://")
