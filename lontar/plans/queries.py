"""The queries of the engine, one per operator, over the driver's tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ml, vocab
from ..functions import urls
from ..functions.sql import register
from ..functions.text import barrier, spread, trimmed
from ..operators import clean, corpus, dedup, frontier, html, language, ratelimit, rules
from ..operators import sentences as sentence_ops
from ..sources import fetch, storage
from ..streaming import pages as streams
from . import extract, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on at length."""
    return spread(table(spark, sf_dir, name))


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# ---- URLs, links and the frontier ------------------------------------------------------------------------------------

_URL_COLUMNS = {
    "url_domain": (urls.url_domain, oracle.url_domain, "domain"),
    "url_normalize": (urls.url_normalize, oracle.url_normalize, "normalized"),
    "url_trap": (urls.url_trap, oracle.url_trap, "trap"),
}
for _name, (_column, _sql, _alias) in _URL_COLUMNS.items():

    def _url(spark, sf_dir, column=_column, alias=_alias):
        return table(spark, sf_dir, "pages").select("page_id", column(F.col("url")).alias(alias))

    query(f"SELECT page_id, {_sql('url')} AS {_alias} FROM pages", _name)(_url)


@query(f"SELECT page_id, ({oracle.url_domain('url')} = 'example.com' OR ends_with({oracle.url_domain('url')}, '.example.com')) AS same FROM pages")
def url_same_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_same_domain(F.col("url"), F.lit("example.com")).alias("same"))


@query(oracle.links())
def extract_links(spark, sf_dir):
    return frontier.extract_links(texts(spark, sf_dir, "pages"))


def _with_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return storage.pages_as_tasks(pages), frontier.extract_links(spread(pages))


#: Pages with an even number are taken as visited, those under 100 as the first tasks.
_FRONTIER = f"WITH links AS ({oracle.links()}), visited AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0), tasks AS (SELECT url, {oracle.url_domain('url')} AS domain, page_id FROM pages)"


def _visited(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select("url")


@query(_FRONTIER + " SELECT link AS url, 1 AS depth, domain, tasks.url AS discovered_from FROM tasks JOIN links ON tasks.url = links.url WHERE link NOT IN (SELECT url FROM visited)")
def frontier_expand(spark, sf_dir):
    tasks, links = _with_links(spark, sf_dir)
    return frontier.expand(tasks, links, _visited(spark, sf_dir)).select("url", "depth", "domain", "discovered_from")


@query(_FRONTIER + ", c AS (SELECT link AS url, domain, tasks.url AS discovered_from FROM tasks JOIN links ON tasks.url = links.url WHERE link NOT IN (SELECT url FROM visited)) SELECT url, min(discovered_from) AS discovered_from FROM c GROUP BY url")
def boundary_capture(spark, sf_dir):
    tasks, links = _with_links(spark, sf_dir)
    children = frontier.expand(tasks.withColumn("depth", F.lit(vocab.MAX_DEPTH - 1)), links, _visited(spark, sf_dir))
    return frontier.boundary(children).select("url", "discovered_from")


@query(
    f"WITH RECURSIVE links AS ({oracle.links()}), reach(url, depth) AS (SELECT url, 0 FROM pages UNION SELECT l.link, r.depth + 1 FROM reach r JOIN links l ON r.url = l.url WHERE r.depth < {vocab.MAX_DEPTH}) "
    "SELECT url, min(depth)::INT AS depth FROM reach GROUP BY url"
)
def crawl_levels(spark, sf_dir):
    """From every page, to the depth of the crawler."""
    storage.work_folder(spark, "levels")
    pages = table(spark, sf_dir, "pages")
    return frontier.crawl(pages.select("url"), frontier.extract_links(pages))


@query(
    _FRONTIER + ", b AS (SELECT link AS url, min(tasks.url) AS f FROM tasks JOIN links ON tasks.url = links.url WHERE link NOT IN (SELECT url FROM visited) GROUP BY link) "
    "SELECT 'web' AS class, url, 'pages' AS source, 'Unknown' AS region FROM b WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)"
)
def boundary_to_seeds(spark, sf_dir):
    tasks, links = _with_links(spark, sf_dir)
    entries = frontier.boundary(frontier.expand(tasks.withColumn("depth", F.lit(vocab.MAX_DEPTH - 1)), links, _visited(spark, sf_dir)))
    seeds = table(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(F.lit("web").alias("class"), "url")
    return frontier.boundary_to_seeds(entries, _visited(spark, sf_dir), seeds).select("class", "url", "source", "region")


@query(
    _FRONTIER + ", b AS (SELECT link AS url FROM tasks JOIN links ON tasks.url = links.url GROUP BY link) "
    "SELECT count(*) FILTER (url IN (SELECT url FROM visited)) AS visited, count(*) FILTER (url NOT IN (SELECT url FROM visited) AND url IN (SELECT url FROM pages)) AS duplicate, "
    "count(*) FILTER (url NOT IN (SELECT url FROM pages)) AS added FROM b"
)
def boundary_counts(spark, sf_dir):
    links = frontier.extract_links(table(spark, sf_dir, "pages")).select(F.col("link").alias("url")).distinct()
    known = table(spark, sf_dir, "pages").groupBy("url").agg(F.max((F.col("page_id") % 2 == 0).cast("int")).alias("v"))
    joined = links.join(known, "url", "left")
    return joined.agg(F.count_if(F.col("v") == 1).alias("visited"), F.count_if(F.col("v") == 0).alias("duplicate"), F.count_if(F.col("v").isNull()).alias("added"))


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def visited_skip(spark, sf_dir):
    return frontier.unvisited(table(spark, sf_dir, "pages"), _visited(spark, sf_dir)).select("page_id")


@query(f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {oracle.url_domain('url')} ORDER BY page_id) AS n FROM pages) WHERE n <= {vocab.DOMAIN_CAP}")
def domain_cap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"))
    return frontier.domain_cap(pages, "page_id").select("page_id")


@query(f"SELECT page_id, row_number() OVER (PARTITION BY {oracle.url_domain('url')} ORDER BY page_id)::INT AS turn FROM pages")
def domain_round_robin(spark, sf_dir):
    storage.work_folder(spark, "turns")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"))
    return frontier.round_robin(pages, "page_id").select("page_id", "turn")


#: Events stand in for a fetch log.
_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 WHEN 'purchase' THEN 503 ELSE 200 END"


def _fetches(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 429).when(kind == "purchase", 503).otherwise(200)
    return table(spark, sf_dir, "events").withColumn("status", status).withColumn("domain", F.concat(F.lit("d"), F.col("user_id").cast("string")))


@query(f"SELECT event_id, ({_STATUS} = 200 AND contains(event_type, 'view')) AS accepted FROM events")
def fetch_accept(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "text/html; charset=utf-8").otherwise("application/json")
    return _fetches(spark, sf_dir).select("event_id", frontier.fetch_accept(F.col("status"), kind).alias("accepted"))


@query(f"SELECT event_id, CASE WHEN {_STATUS} IN (429, 503) THEN CASE WHEN event_id % 4 < 2 THEN 'requeue' ELSE 'drop' END ELSE 'done' END AS decision FROM events")
def retry_policy(spark, sf_dir):
    return _fetches(spark, sf_dir).select("event_id", frontier.retry_decision(F.col("status"), F.col("event_id") % 4).alias("decision"))


@query(f"SELECT page_id, NOT (starts_with({oracle.url_path('url')}, '/en/') OR starts_with({oracle.url_path('url')}, '/fr/1')) AS allowed FROM pages")
def robots_check(spark, sf_dir):
    rules_ = F.array(F.lit("/en/"), F.lit("/fr/1"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", frontier.robots_allows(rules_, urls.url_path(F.col("url"))).alias("allowed"))


@query("SELECT page_id FROM pages WHERE length(html) >= 100")
def min_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(frontier.min_content(F.col("html"))).select("page_id")


@query("SELECT page_id, md5(html) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def content_dedup(spark, sf_dir):
    return dedup.content_dedup(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


# ---- HTML ------------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {oracle.rep('html', vocab.DROPCAP_HTML)} AS html FROM pages")
def dropcap_html_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.dropcap_html_regex(F.col("html")).alias("html"))


@query()
def dropcap_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.dropcap_html("html").alias("html"))


@query(f"SELECT page_id, {oracle.fallback_text('html')} AS text FROM pages")
def fallback_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", html.fallback_text(F.col("html")).alias("text"))


@query()
def main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.main_content("html").alias("text"))


@query()
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_text("html").alias("text"))


# ---- whole texts -----------------------------------------------------------------------------------------------------

for _step in clean.STEPS:

    def _clean(spark, sf_dir, step=_step):
        return texts(spark, sf_dir, "documents").select("doc_id", step(F.col("text")).alias("text"))

    query(f"SELECT doc_id, {oracle.CLEAN[_step.__name__]('text')} AS text FROM documents", _step.__name__)(_clean)

_CLEANED, _LAST = oracle.staged("documents", "doc_id, lang, source", "text", list(oracle.CLEAN.values()), "clean")
_RAW = f"raw AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (s), {oracle.trimmed('s')} AS raw FROM (SELECT doc_id, lang, source, unnest(parts) AS s, generate_subscripts(parts, 1)::INT - 1 AS position FROM (SELECT doc_id, lang, source, {oracle.sentences(oracle.presplit('text'))} AS parts FROM {_LAST}))) WHERE raw <> '')"
_SENTENCES, _CLEAN_ROWS = oracle.staged("raw", "doc_id, lang, source, position", "raw", [oracle.sentence_step(n) for n in vocab.SENTENCE_STEPS], "sent")
_JUDGED = f"judged AS MATERIALIZED (SELECT doc_id, lang, source, position, raw AS sentence, {oracle.reason('raw')} AS reason FROM {_CLEAN_ROWS})"
#: CTEs up to judged(doc_id, lang, source, position, sentence, reason).
PIPELINE_SQL = f"WITH {_CLEANED},\n{_RAW},\n{_SENTENCES},\n{_JUDGED}"


@query(f"WITH {_CLEANED} SELECT doc_id, text FROM {_LAST}")
def clean_text(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", clean.clean_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {oracle.presplit('text')} AS text FROM documents")
def presplit_fix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.presplit_fix(F.col("text")).alias("text"))


@query(f"SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1)::INT - 1 AS position FROM (SELECT doc_id, {oracle.sentences('text')} AS parts FROM documents)")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(clean.split_sentences(F.col("text"))).alias("position", "sentence"))


#: Sentences of the texts as they are: what single steps and rules are tried on.
_PLAIN = f"plain AS (SELECT doc_id, position, {oracle.trimmed('s')} AS s FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1)::INT - 1 AS position FROM (SELECT doc_id, {oracle.sentences('text')} AS parts FROM documents)))"


def _plain(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(clean.split_sentences(F.col("text"))).alias("position", "s"))
    return barrier(rows, s=trimmed(F.col("s")))


@query(f"WITH {_PLAIN} SELECT doc_id, position, s AS sentence FROM plain WHERE s <> ''")
def explode_nonempty(spark, sf_dir):
    return _plain(spark, sf_dir).filter("s <> ''").withColumnRenamed("s", "sentence")


for _name in vocab.SENTENCE_STEPS:

    def _sentence(spark, sf_dir, step=_name):
        return _plain(spark, sf_dir).select("doc_id", "position", sentence_ops.step(step, F.col("s")).alias("sentence"))

    query(f"WITH {_PLAIN} SELECT doc_id, position, {oracle.sentence_step(_name)('s')} AS sentence FROM plain", _name)(_sentence)


@query(f"WITH {_CLEANED},\n{_RAW},\n{_SENTENCES} SELECT doc_id, position, raw AS sentence FROM {_CLEAN_ROWS}")
def clean_sentence(spark, sf_dir):
    rows = extract.sentences(extract.cleaned(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "position", sentence_ops.clean_sentence(F.col("raw")).alias("sentence"))


for _name, _rule in rules.CASCADE:

    def _flag(spark, sf_dir, rule=_rule):
        return _plain(spark, sf_dir).select("doc_id", "position", rule(F.col("s")).alias("holds"))

    query(f"WITH {_PLAIN} SELECT doc_id, position, ({oracle.RULES[_name]('s')}) AS holds FROM plain", f"rule_{_name}")(_flag)


def _judged(spark, sf_dir):
    return extract.judged(extract.sentences(extract.cleaned(table(spark, sf_dir, "documents"))))


@query(PIPELINE_SQL + " SELECT doc_id, position, sentence, reason FROM judged")
def validity_cascade(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "position", "sentence", "reason")


_PAGES_CLEANED, _PAGES_LAST = oracle.staged("texts", "doc_id, lang, source", "text", list(oracle.CLEAN.values()), "clean")
_PAGES_SQL = (
    f"WITH texts AS MATERIALIZED (SELECT page_id AS doc_id, '' AS lang, '' AS source, {oracle.fallback_text(oracle.rep('html', vocab.DROPCAP_HTML))} AS text FROM pages "
    f"WHERE length(html) >= 100 AND page_id IN (SELECT min(page_id) FROM pages WHERE length(html) >= 100 GROUP BY md5(html))),\n{_PAGES_CLEANED},\n{_RAW.replace(_LAST, _PAGES_LAST)},\n{_SENTENCES},\n{_JUDGED}"
)


@query(_PAGES_SQL + " SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def reject_reason_histogram(spark, sf_dir):
    """The flagship: fetched pages, deduplicated, as judged sentences, counted by reason."""
    texts = extract.page_texts(table(spark, sf_dir, "pages"))
    return extract.judged(extract.sentences(extract.cleaned(texts))).groupBy("reason").agg(F.count("*").alias("n"))


# ---- language, routing, output ---------------------------------------------------------------------------------------

_STOP = {k: f"len(list_distinct(list_filter({oracle.words('lower(text)')}, lambda v: v IN {oracle.some(ws)})))" for k, ws in language.STOP_WORDS.items()}
_MOST = f"greatest({', '.join(_STOP)})"


@query(
    f"SELECT doc_id, CASE WHEN {_MOST} = 0 THEN 'unknown' {' '.join(f'WHEN {k} = {_MOST} THEN {oracle.lit(k)}' for k in _STOP)} END AS lang "
    f"FROM (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _STOP.items())} FROM documents)"
)
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", language.detect_language(F.col("text")).alias("lang"))


_GATE = f"CASE WHEN length({oracle.trimmed('text')}) < 15 THEN 'too_short' ELSE coalesce(lang, 'detection_failed') END"


@query(f"SELECT doc_id, {_GATE} AS detected_lang, ({_GATE} IN ('en', 'fr')) AS is_target FROM documents")
def lang_gate(spark, sf_dir):
    target, lang = language.gate(F.col("text"), F.col("lang"), ("en", "fr"))
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("detected_lang"), target.alias("is_target"))


#: Valid sentences of the documents; a document's source stands for its URL, its language for its class.
_VALID = PIPELINE_SQL + ", valid AS (SELECT *, CASE WHEN length(trim(sentence)) < 15 THEN 'too_short' ELSE lang END AS detected_lang FROM judged WHERE reason IN ('valid', 'whitelisted'))"


def _valid(spark, sf_dir):
    return extract.extract_sentences(table(spark, sf_dir, "documents"), F.col("lang"), ("en", "fr"))


@query(_VALID + " SELECT doc_id, position, sentence, detected_lang, detected_lang IN ('en', 'fr') AS is_target FROM valid")
def extract_sentences(spark, sf_dir):
    return _valid(spark, sf_dir).select("doc_id", "position", "sentence", "detected_lang", "is_target")


@query(_VALID + " SELECT sentence FROM valid WHERE detected_lang IN ('en', 'fr')")
def extract_sentences_simple(spark, sf_dir):
    return extract.target_sentences(table(spark, sf_dir, "documents"), F.col("lang"), ("en", "fr"))


_DEDUPED = _VALID + ", deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, sentence ORDER BY doc_id, position) AS n FROM valid) WHERE n = 1)"


def _deduped(spark, sf_dir):
    rows = _valid(spark, sf_dir).withColumn("url", F.col("source")).withColumn("position", F.struct("doc_id", "position"))
    return dedup.sentence_dedup(rows).withColumn("position", F.col("position.position"))


@query(_DEDUPED + " SELECT doc_id, position, source, sentence FROM deduped")
def sentence_dedup_per_url(spark, sf_dir):
    return _deduped(spark, sf_dir).select("doc_id", "position", "source", "sentence")


@query(_DEDUPED + " SELECT doc_id, position, CASE WHEN detected_lang IN ('en', 'fr') THEN 'kept' ELSE 'rejected' END AS route FROM deduped")
def route_by_language(spark, sf_dir):
    kept, rejected = dedup.route(_deduped(spark, sf_dir))
    return kept.withColumn("route", F.lit("kept")).union(rejected.withColumn("route", F.lit("rejected"))).select("doc_id", "position", "route")


def _records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.initcap("lang").alias("religion"), "source", F.lit("Region").alias("region"), F.col("text").alias("sentence"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("detected_lang"))


_RECORDS = "upper(lang[1]) || lang[2:] AS Label, source AS Denomination, 'Region' AS Location, '' AS Date, '' AS Title, text AS Sentence_Unit, 'https://x.example/' || doc_id AS Link"


@query(f"SELECT {_RECORDS} FROM documents")
def map_output(spark, sf_dir):
    return corpus.map_output(_records(spark, sf_dir))


@query(f"SELECT {_RECORDS}, lang AS Detected_Language FROM documents WHERE lang <> 'en'")
def sink_rejected(spark, sf_dir):
    """Written as CSV and read again."""
    path = storage.work_folder(spark, "rejected")
    storage.write_corpus(corpus.map_rejected(_records(spark, sf_dir).filter("detected_lang <> 'en'")), path)
    return storage.read_corpus(spark, path, storage.CORPUS_SCHEMA + ", Detected_Language string")


def _written(spark, sf_dir):
    path = storage.work_folder(spark, "corpus")
    storage.write_by_class(corpus.map_output(_records(spark, sf_dir)), path)
    return storage.read_corpus(spark, path).select(*vocab.OUTPUT_COLUMNS)


@query(f"SELECT {_RECORDS} FROM documents")
def sink_by_class(spark, sf_dir):
    return _written(spark, sf_dir)


@query(f"WITH c AS (SELECT {_RECORDS} FROM documents) SELECT Label, count(*) FILTER ({oracle.trimmed('Sentence_Unit')} <> '') AS sentences, count(DISTINCT nullif(Link, '')) AS sites FROM c GROUP BY Label")
def scan_scraped_csv(spark, sf_dir):
    return storage.scraped_counts(_written(spark, sf_dir))


@query(f"SELECT {_RECORDS} FROM documents")
def scan_corpus_csv(spark, sf_dir):
    path = storage.work_folder(spark, "corpus")
    storage.write_corpus(corpus.map_output(_records(spark, sf_dir)), path)
    return storage.read_corpus(spark, path)


@query(f"SELECT {_RECORDS} FROM documents")
def scan_combined_latest(spark, sf_dir):
    folder, rows = storage.work_folder(spark, "combined"), corpus.map_output(_records(spark, sf_dir))
    for stamp, kept in (("20240101_000000", rows.withColumn("Link", F.lit("old"))), ("20240203_120000", rows)):
        storage.write_corpus(kept, f"{folder}/corpus_{stamp}.csv")
    return storage.read_corpus(spark, storage.latest_file(spark, f"{folder}/corpus_*.csv"))


@query("SELECT text AS sentence, lang AS label FROM documents UNION ALL SELECT text, role FROM conversations")
def combine_csv(spark, sf_dir):
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    return corpus.combine([docs.select(F.col("text").alias("sentence"), F.col("lang").alias("label")), turns.select(F.col("role").alias("label"), F.col("text").alias("sentence"))])


@query("SELECT coalesce(lang, 'TOTAL') AS label, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def combine_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("TOTAL")).alias("label"), "n")


# ---- line files and JSON state ---------------------------------------------------------------------------------------


@query("SELECT DISTINCT url AS value FROM pages")
def scan_history(spark, sf_dir):
    path, seen = storage.work_folder(spark, "history"), table(spark, sf_dir, "pages").select(F.concat(F.lit("  "), F.col("url"), F.lit(" ")).alias("value"))
    storage.write_lines(seen, path)
    storage.write_lines(seen.union(seen.select(F.lit(" ")).limit(1)), path)
    return storage.read_lines(spark, path)


@query("SELECT DISTINCT md5(html) AS value FROM pages")
def scan_hashes(spark, sf_dir):
    path = storage.work_folder(spark, "hashes")
    storage.write_lines(table(spark, sf_dir, "pages").select(F.md5("html").alias("value")), path)
    return storage.read_lines(spark, path)


@query("SELECT url FROM pages WHERE page_id % 3 = 1")
def scan_text_lines(spark, sf_dir):
    path = storage.work_folder(spark, "texts")
    storage.write_lines(table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("  ").alias("value")), path)
    return storage.read_texts(spark, path).withColumnRenamed("value", "url")


@query(f"SELECT url, 0 AS depth, 'Web' AS religion, {oracle.url_domain('url')} AS domain FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def scan_queue(spark, sf_dir):
    path = storage.work_folder(spark, "queue")
    storage.write_json(storage.pages_as_tasks(table(spark, sf_dir, "pages")), path)
    return storage.read_queue(spark, path, _visited(spark, sf_dir)).select("url", "depth", "religion", "domain")


@query("SELECT url, 'Web' AS religion, 'Unknown' AS region FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def scan_boundary(spark, sf_dir):
    path = storage.work_folder(spark, "boundary")
    storage.write_json(storage.pages_as_tasks(table(spark, sf_dir, "pages")).drop("depth"), path)
    return storage.read_queue(spark, path, _visited(spark, sf_dir)).select("url", "religion", "region")


@query("SELECT sum(page_id)::DOUBLE AS total_runtime_seconds FROM pages")
def scan_stats(spark, sf_dir):
    path = storage.work_folder(spark, "stats")
    storage.write_json(table(spark, sf_dir, "pages").agg(F.sum("page_id").cast("double").alias("total_runtime_seconds")), path)
    return storage.read_stats(spark, path)


@query(f"SELECT url, 0 AS depth, CASE WHEN page_id % 2 = 0 THEN 'Catholic' ELSE 'Islam' END AS religion, 'S' || page_id % 7 AS source, 'Unknown' AS region, {oracle.url_domain('url')} AS domain FROM pages")
def scan_seeds(spark, sf_dir):
    path = storage.work_folder(spark, "seeds")
    sites = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, "catholic").otherwise("iSLAM").alias("class"), F.struct("url", F.concat(F.lit("S"), (F.col("page_id") % 7).cast("string")).alias("source")).alias("site"))
    # A seed file per host group: a file is one record, so it stays small.
    files = sites.groupBy("class", F.pmod(F.xxhash64("site.url"), F.lit(64))).agg(F.collect_list("site").alias("sites")).select(F.to_json(F.map_from_arrays(F.array("class"), F.array("sites"))).alias("value"))
    storage.write_lines(files, path)
    lines = spark.read.text(path).select(F.from_json("value", storage.SITE_SCHEMA).alias("seeds"))
    return frontier.seed_tasks(lines)


@query("SELECT DISTINCT 'page-' || page_id AS name FROM pages WHERE page_id % 5 <> 0")
def check_required_files(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"))
    return storage.missing_files(names, names.filter("page_id % 5 = 0"))


# ---- aggregates ------------------------------------------------------------------------------------------------------


@query(_DEDUPED + " SELECT lang AS label, count(*) AS sentences FROM deduped GROUP BY lang")
def sentences_by_class(spark, sf_dir):
    return _deduped(spark, sf_dir).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("sentences"))


@query("SELECT lang AS label, count(*) AS sites, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def sites_by_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("sites"), F.countDistinct("source").alias("sources"))


@query(f"SELECT {oracle.url_domain('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def pages_by_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query("SELECT coalesce(source, 'TOTAL') AS source, sum(n_chars)::BIGINT AS chars, count(*) AS documents FROM documents GROUP BY ROLLUP (source)")
def totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("documents")).select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "chars", "documents")


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def class_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT min(n) AS smallest, least(min(n), 2000000 // 3) AS capped FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def min_class_size(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.agg(F.min("n").alias("smallest"), F.least(F.min("n"), F.lit(2_000_000 // 3)).alias("capped"))


#: A document is predicted good if it has 50 words.
_PREDICTED = f"predicted AS (SELECT quality AS label, ({oracle.n_words('text')} >= 50)::INT AS prediction FROM labels JOIN documents USING (doc_id))"
_CONFUSION = f"WITH {_PREDICTED}, confusion AS (SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM predicted p WHERE p.label = a.c AND p.prediction = b.c) AS n FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c))"


def _predicted(spark, sf_dir):
    from ..functions.text import words

    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(words(F.col("text"))) >= 50).cast("int").alias("prediction"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), "prediction")


@query(_CONFUSION + " SELECT label, prediction, n FROM confusion")
def confusion_matrix(spark, sf_dir):
    return corpus.confusion_matrix(_predicted(spark, sf_dir), "label", "prediction", [0, 1])


@query(
    _CONFUSION + ", c AS (SELECT label AS c, sum(n) AS support, sum(n) FILTER (label = prediction) AS hit FROM confusion GROUP BY label), p AS (SELECT prediction AS c, sum(n) AS made FROM confusion GROUP BY prediction), "
    "m AS (SELECT support, hit, CASE WHEN made > 0 THEN hit / made ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c JOIN p USING (c)) "
    "SELECT sum(hit) / sum(support) AS accuracy, sum(support * p) / sum(support) AS precision, sum(support * r) / sum(support) AS recall, "
    "sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support) AS f1 FROM m"
)
def weighted_prf(spark, sf_dir):
    return corpus.weighted_prf(corpus.confusion_matrix(_predicted(spark, sf_dir), "label", "prediction", [0, 1]))


@query(f"WITH {_PREDICTED} SELECT label, avg((label = prediction)::INT) AS accuracy FROM predicted GROUP BY label")
def per_class_accuracy(spark, sf_dir):
    return corpus.per_class_accuracy(_predicted(spark, sf_dir), "label", "prediction")


# ---- samples, splits, orders -----------------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS every FROM documents)"


@query(f"WITH {_RANKED} SELECT doc_id, lang FROM ranked WHERE n <= (SELECT min(every) FROM ranked)")
def balance_undersample(spark, sf_dir):
    return corpus.balance(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"WITH {_RANKED} SELECT doc_id, lang FROM ranked WHERE n <= least((SELECT min(every) FROM ranked), {2_000_000 // 3})")
def balance_capped(spark, sf_dir):
    return corpus.balance(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", cap=2_000_000 // 3)


@query(f"WITH {_RANKED} SELECT doc_id, lang, CASE WHEN n <= floor(every * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS split FROM ranked")
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 END::INT AS label FROM documents WHERE lang IN ('en', 'fr')")
def label_lookup(spark, sf_dir):
    return corpus.label_ids(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"en": 0, "fr": 1}, "lang").select("doc_id", "label")


@query("SELECT page_id, url[-60:] AS url FROM pages ORDER BY page_id DESC LIMIT 8")
def recent_k(spark, sf_dir):
    return table(spark, sf_dir, "pages").orderBy(F.desc("page_id")).limit(8).select("page_id", F.right("url", F.lit(60)).alias("url"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def preview_k(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(10)


_P = "list_transform(embedding[1:3], lambda x: exp(x::DOUBLE - list_max(embedding[1:3])::DOUBLE))"
_PROBS = f"list_transform({_P}, lambda y: y / list_sum({_P}))"


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("logits"))
    return rows.withColumn("p", corpus.softmax(F.col("logits")))


@query(f"SELECT vec_id, (list_position(embedding[1:3], list_max(embedding[1:3])) - 1)::INT AS label, list_max({_PROBS}) AS confidence FROM embeddings")
def argmax_label(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", corpus.argmax_label(F.col("logits")).alias("label"), F.array_max("p").alias("confidence"))


@query(f"SELECT 'v' || vec_id AS text, label::VARCHAR AS prediction, printf('%.4f', list_max(p)) AS confidence, printf('%.4f', p[1]) AS islam_prob, printf('%.4f', p[2]) AS catholic_prob, printf('%.4f', p[3]) AS protestant_prob FROM (SELECT vec_id, label, {_PROBS} AS p FROM embeddings)")
def sink_pred_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("prediction")).join(_scored(spark, sf_dir), "vec_id").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    path = storage.work_folder(spark, "predictions")
    storage.write_corpus(storage.prediction_rows(rows, F.col("p"), list(vocab.LABELS)), path)
    return storage.read_corpus(spark, path, "text string, prediction string, confidence string, islam_prob string, catholic_prob string, protestant_prob string")


@query("SELECT 'v' || vec_id AS text, label FROM embeddings")
def sink_pred_json(spark, sf_dir):
    path = storage.work_folder(spark, "predictions")
    storage.write_json(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "label"), path)
    return spark.read.schema("text string, label int").json(path)


@query("SELECT source, repeat('█', (floor(n * 20.0 / greatest(max(n) OVER (), 1)))::INT) || repeat('░', 20 - floor(n * 20.0 / greatest(max(n) OVER (), 1))::INT) AS bar FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def class_bars(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top")).first().top or 1
    return counts.select("source", corpus.bar(F.col("n") / F.lit(top)).alias("bar"))


# ---- rate limits and counters ----------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE log AS (SELECT 'd' || user_id AS domain, epoch(ts)::DOUBLE AS t, {_STATUS} AS st, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s(domain, i, status, delay, extra, cooldown, ok, e429, e503, other) AS (
  SELECT DISTINCT domain, 0::BIGINT, 'active', {vocab.START_DELAY}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM log
  UNION ALL
  SELECT s.domain, l.i, CASE WHEN st IN (429, 503) THEN 'cooling_down' WHEN st = 200 AND status = 'cooling_down' AND t >= cooldown THEN CASE WHEN extra > 0 THEN 'slowed' ELSE 'active' END ELSE status END,
    CASE WHEN st = 200 AND ok + 1 >= {vocab.SUCCESSES} THEN greatest({vocab.MIN_DELAY}, delay * {vocab.SPEED_UP}) WHEN st NOT IN (200, 429, 503) THEN least({vocab.MAX_DELAY}, delay * {vocab.SLOW_DOWN}) ELSE delay END,
    CASE WHEN st IN (429, 503) THEN extra + {vocab.COOLDOWN_DELAY} ELSE extra END, CASE WHEN st IN (429, 503) THEN t + {vocab.COOLDOWN_SECONDS} ELSE cooldown END,
    ok + (st = 200)::INT, e429 + (st = 429)::INT, e503 + (st = 503)::INT, other + (st NOT IN (200, 429, 503))::INT
  FROM s JOIN log l ON l.domain = s.domain AND l.i = s.i + 1)
SELECT domain, status, delay AS adaptive_delay, extra AS extra_delay, delay + extra AS current_delay, cooldown AS cooldown_until, ok AS successes, e429 AS errors_429, e503 AS errors_503, other AS other_errors
FROM (SELECT *, max(i) OVER (PARTITION BY domain) AS last FROM s) WHERE i = last"""
)
def rate_limit_fold(spark, sf_dir):
    events = _fetches(spark, sf_dir).withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))") / 1e6)
    return ratelimit.rate_limit_fold(events, "domain", "t", "status", "event_id")


@query(
    "WITH c AS (SELECT (SELECT count(*) FROM pages) AS sites, (SELECT count(*) FROM documents) AS sentences, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed, 7 AS dup, (SELECT count(*) FROM labels) AS queue) "
    "SELECT sites, sentences, 720.0::DOUBLE AS total_elapsed, sites / 600.0 * 60 AS urls_per_minute, sites / 600.0 AS urls_per_second, queue / (sites / 600.0) AS remaining_seconds, 600.0 + queue / (sites / 600.0) AS estimated_total_seconds, "
    "(sites + failed + dup) / (sites + failed + dup + queue) * 100 AS progress_percent FROM c"
)
def crawl_metrics(spark, sf_dir):
    n = lambda name, what, where="true": table(spark, sf_dir, name).filter(where).agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    rows = n("pages", "sites").union(n("documents", "sentences")).union(n("events", "failed", "event_type = 'error'")).union(n("labels", "queue"))
    counters = rows.agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("sites", "sentences", "failed", "queue")], F.lit(7).alias("duplicates"))
    return ratelimit.crawl_metrics(counters, F.lit(600.0), F.lit(120.0))


@query("SELECT domain, count(*) AS queued FROM (SELECT " + oracle.url_domain("url") + " AS domain FROM pages) GROUP BY domain")
def queue_by_domain(spark, sf_dir):
    return storage.pages_as_tasks(table(spark, sf_dir, "pages")).groupBy("domain").agg(F.count("*").alias("queued"))


# ---- streams and the classifier --------------------------------------------------------------------------------------


def _arriving(df: DataFrame, parts: list, name: str) -> DataFrame:
    """df as a file stream, its parts (conditions) arriving one after the other."""
    spark, path = df.sparkSession, storage.work_folder(df.sparkSession, name)
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT DISTINCT md5(text) AS content_hash FROM documents")
def stream_content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = streams.content_dedup(_arriving(docs, ["doc_id % 2 = 0", "doc_id % 2 = 1"], "arriving"), "text").select("content_hash")
    path = storage.work_folder(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string").parquet(f"{path}/out")


@query(f"SELECT {_RECORDS} FROM documents")
def sink_periodic(spark, sf_dir):
    rows = corpus.map_output(_records(spark, sf_dir))
    path = storage.work_folder(spark, "stream")
    streams.flush_by_class(_arriving(rows, ["Label <> 'En'", "Label = 'En'"], "arriving"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(*vocab.OUTPUT_COLUMNS)


@query("SELECT domain, status, adaptive_delay, extra_delay, successes, errors_429, errors_503, other_errors FROM (" + ORACLES["rate_limit_fold"] + ")")
def stream_rate_limits(spark, sf_dir):
    events = _fetches(spark, sf_dir).select("domain", F.col("event_id").alias("seq"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))") / 1e6).alias("t"), "status")
    half = events.agg((F.max("seq") / 2).alias("h")).first().h
    path = storage.work_folder(spark, "stream")
    states = streams.rate_limits(_arriving(events, [F.col("seq") <= half, F.col("seq") > half], "arriving"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("domain").agg(F.max_by(F.struct("*"), "events").alias("s")).select("s.*")
    return last.select("domain", "status", "adaptive_delay", "extra_delay", "successes", "errors_429", "errors_503", "other_errors")


@query()
def train_classifier(spark, sf_dir):
    """A classifier of languages: balanced, split, trained, judged on the test part."""
    labels = {"de": 0, "en": 1, "es": 2, "fr": 3}
    docs = corpus.label_ids(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("Sentence_Unit")), labels, "lang")
    rows = corpus.stratified_split(corpus.balance(docs, "lang", "doc_id"), "lang", "doc_id")
    model = ml.train(rows.filter("split = 'train'"))
    scored = ml.classify(model, rows.filter("split = 'test'"), labels)
    return ml.evaluate(scored.select("lang", "predicted"), "lang", "predicted", list(labels))


@query("SELECT * FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) t(name, id)")
def sink_model(spark, sf_dir):
    """A model of the documents' languages, saved and loaded again; the label map that lies beside it."""
    path, labels = storage.work_folder(spark, "model"), {"de": 0, "en": 1, "es": 2, "fr": 3}
    docs = corpus.label_ids(table(spark, sf_dir, "documents").select("lang", F.col("text").alias("Sentence_Unit")), labels, "lang")
    ml.save(ml.train(docs, iterations=1), path, labels, {"max_length": ml.MAX_TOKENS})
    loaded = ml.load(path)[1]
    return spark.createDataFrame(list(loaded.items()), "name string, id int")


@query(f"SELECT url, 0 AS depth, 'Web' AS religion, 'pages' AS source, 'Unknown' AS region, {oracle.url_domain('url')} AS domain, 0 AS retry_count FROM pages")
def sink_queue(spark, sf_dir):
    path = storage.work_folder(spark, "queue")
    storage.write_json(storage.pages_as_tasks(table(spark, sf_dir, "pages")), path)
    return storage.read_queue(spark, path)


@query("SELECT 'history' AS name, count(*) AS n FROM (SELECT DISTINCT trim(url) FROM pages) UNION ALL SELECT 'history.1', count(*) FROM (SELECT DISTINCT trim(url) FROM pages)")
def archive_state(spark, sf_dir):
    """The history, archived twice: the second one finds its name taken."""
    folder, moved = storage.work_folder(spark, "state"), []
    for _ in range(2):
        storage.write_lines(table(spark, sf_dir, "pages").select("url"), f"{folder}/history")
        moved.append(storage.archive(spark, f"{folder}/history", f"{folder}/archive"))
    parts = [storage.read_lines(spark, path).agg(F.count("*").alias("n")).select(F.lit(path.rpartition("/")[2]).alias("name"), "n") for path in moved]
    return parts[0].union(parts[1])


@query("SELECT 'corpus_20240203_120000.csv' AS name")
def latest_file(spark, sf_dir):
    folder = storage.work_folder(spark, "latest")
    for stamp in ("20240203_120000", "20240101_000000"):
        storage.write_lines(table(spark, sf_dir, "region").select("r_name"), f"{folder}/corpus_{stamp}.csv")
    found = storage.latest_file(spark, f"{folder}/corpus_*.csv")
    return spark.createDataFrame([(found.rpartition("/")[2],)], "name string")


@query("SELECT 'drained' AS place, text AS value FROM documents UNION ALL SELECT 'buffer', text FROM benchmark")
def drain_batch(spark, sf_dir):
    """A buffer is drained at once; what comes later lies in a new one."""
    folder = storage.work_folder(spark, "buffer")
    table(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.parquet(f"{folder}/buffer")
    taken = storage.drain(spark, f"{folder}/buffer", f"{folder}/drained")
    table(spark, sf_dir, "benchmark").select(F.col("text").alias("value")).write.parquet(f"{folder}/buffer")
    parts = [spark.read.schema("value string").parquet(p).select(F.lit(place).alias("place"), "value") for place, p in (("drained", taken), ("buffer", f"{folder}/buffer"))]
    return parts[0].union(parts[1])


@query(f"SELECT page_id, [{', '.join(repr(a) for a in vocab.USER_AGENTS)}][1 + (('0x' || substr(md5(url), 1, 8))::BIGINT % {len(vocab.USER_AGENTS)})::INT] AS user_agent FROM pages")
def user_agent_pick(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fetch.user_agent_pick(F.col("url")).alias("user_agent"))


@query("SELECT * FROM (VALUES ('pyspark', true), ('pandas', true), ('pyarrow', true), ('numpy', true)) t(module, present)")
def check_deps(spark, sf_dir):
    return fetch.check_deps(spark)


@query(
    f"WITH t AS (SELECT page_id, {oracle.url_domain('url')} AS domain FROM pages), r AS (SELECT page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS n FROM t), "
    f"f AS (SELECT page_id FROM r WHERE n <= {vocab.DOMAIN_LIMIT} ORDER BY page_id LIMIT {vocab.GLOBAL_LIMIT}) SELECT page_id, page_id IN (SELECT page_id FROM f) AS admitted FROM pages"
)
def limiter_admission(spark, sf_dir):
    """Which pages' requests may start at once, with none under way."""
    tasks = table(spark, sf_dir, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"))
    return fetch.admitted(tasks, "page_id", tasks.limit(0)).select("page_id", "admitted")


# ---- the rest --------------------------------------------------------------------------------------------------------


@query("SELECT domain, status, extra_delay, (1700000000.0 < cooldown_until) AS cooling_down, (extra_delay > 0) AS slowed, greatest(0.0, cooldown_until - 1700000000.0) AS cooldown_remaining FROM (" + ORACLES["rate_limit_fold"] + ")")
def domain_health(spark, sf_dir):
    return ratelimit.domain_report(rate_limit_fold(spark, sf_dir), F.lit(1.7e9)).drop("errors_429", "errors_503")


@query(f"SELECT page_id, {oracle.url_domain('url')} AS domain, {oracle.url_normalize('url')} AS normalized, len({oracle.words('url')}) AS n FROM pages")
def sql_functions(spark, sf_dir):
    """The functions that SQL users have."""
    register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("lontar_pages")
    return spark.sql("SELECT page_id, lontar_url_domain(url) AS domain, lontar_url_normalize(url) AS normalized, cast(size(lontar_text_words(url)) AS BIGINT) AS n FROM lontar_pages")


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) GROUP BY url")
def sink_boundary(spark, sf_dir):
    """First-wins by URL, minus visited, written as JSON and read again."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    first = frontier.unvisited(pages.groupBy("url").agg(F.min("page_id").alias("page_id")), _visited(spark, sf_dir))
    path = storage.work_folder(spark, "boundary")
    storage.write_json(first, path)
    return spark.read.schema("url string, page_id long").json(path)
