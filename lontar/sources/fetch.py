"""Fetching pages through something that can be plugged in, politely.

A fetcher is a picklable callable: url and user agent to (status, content type, body). It runs in the tasks; none here uses
a network. What is fetched from whom, and how fast, is decided before (frontier, rate limits).
"""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab

Fetcher = Callable[[str, str], tuple[int, str, str | None]]
FETCHED = "url string, user_agent string, status int, content_type string, html string"


def user_agent_pick(key: Column) -> Column:
    """One of the user agents, by a digest of the key, so that a retried task asks in the same name."""
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*[F.lit(a) for a in vocab.USER_AGENTS]), F.pmod(number, F.lit(len(vocab.USER_AGENTS))).cast("int"))


def scan_http(tasks: DataFrame, fetcher: Fetcher, url: str = "url") -> DataFrame:
    """FETCHED, a row for each task. A fetcher that raises makes a row of status 0; a null URL is not fetched."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("user_agent", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("html", pa.string())])
        for batch in batches:
            for u, agent in zip(batch.column("url").to_pylist(), batch.column("user_agent").to_pylist(), strict=True):
                try:
                    found = fetcher(u, agent)
                except Exception:  # noqa: BLE001  whatever a fetcher does wrong is that page's failure
                    found = (0, "", None)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (u, agent, *found), strict=True))], schema)

    named = tasks.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), user_agent_pick(F.col(url)).alias("user_agent"))
    return named.mapInArrow(fetch, FETCHED)


class FolderFetcher:
    """Pages from a folder that all tasks can read: a file for each URL, named by the SHA-1 of it."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, url: str, user_agent: str) -> tuple[int, str, str | None]:
        system, path = fs.FileSystem.from_uri(self.folder)
        try:
            with system.open_input_file(f"{path}/{hashlib.sha1(url.encode()).hexdigest()}") as file:
                return 200, "text/html", file.read().decode(errors="replace")
        except FileNotFoundError:
            return 404, "", None


def admitted(tasks: DataFrame, order: str, running: DataFrame, domain: str = "domain", all_at_once: int = vocab.GLOBAL_LIMIT, per_domain: int = vocab.DOMAIN_LIMIT) -> DataFrame:
    """tasks with ``admitted``: whether a task may start while those of running are under way. A domain takes its first tasks in
    order up to per_domain, what it runs included; of those the first all_at_once, what runs included, start. The rest wait."""
    from pyspark.sql import Window

    busy = running.groupBy(F.col(domain).alias("_domain")).agg(F.count("*").alias("_busy"))
    free = max(0, all_at_once - (busy.agg(F.sum("_busy")).first()[0] or 0))
    ranked = tasks.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(order))).filter(F.col("_n") <= per_domain)
    within = ranked.join(busy, ranked[domain].eqNullSafe(busy["_domain"]), "left").filter(F.col("_n") + F.coalesce("_busy", F.lit(0)) <= per_domain)
    first = within.orderBy(order).limit(free).select(F.col(order).alias("_started"))
    return tasks.join(first, tasks[order] == first["_started"], "left").withColumn("admitted", F.col("_started").isNotNull()).drop("_started")


def check_deps(spark: SparkSession, modules: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy")) -> DataFrame:
    """module, present: which of the modules the driver can import."""
    return spark.createDataFrame([(m, importlib.util.find_spec(m) is not None) for m in modules], "module string, present boolean")
