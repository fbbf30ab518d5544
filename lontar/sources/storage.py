"""Files of the engine's own formats: line files, JSON state, CSV tables; where intermediate ones are kept."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import trimmed
from ..functions.urls import url_domain

TASK_SCHEMA = "url string, depth int, religion string, source string, region string, domain string, retry_count int"
SITE_SCHEMA = "map<string, array<struct<url:string,source:string,region:string>>>"
CORPUS_SCHEMA = ", ".join(f"{c} string" for c in vocab.OUTPUT_COLUMNS)
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; a folder of this machine only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    path = path or (Path(tempfile.gettempdir()) / "checkpoints").as_uri()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/lontar-files/{name}-{uuid.uuid4().hex}"


# ---- readers ---------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the distinct lines, trimmed, blank ones left out."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("value")).filter("value <> ''").distinct()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines, trimmed, blank ones left out; repeated ones stay."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("value")).filter("value <> ''")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """seeds: one map of class to sites per file."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", SITE_SCHEMA).alias("seeds"))


def read_queue(spark: SparkSession, path: str, visited: DataFrame | None = None, one_array: bool = False) -> DataFrame:
    """Queued tasks, those visited (column url) left out; records that can't be parsed are none.

    A snapshot is a task per line; one_array: a single JSON array, as a crawler of one process writes it."""
    tasks = spark.read.schema(TASK_SCHEMA).option("multiLine", one_array).option("mode", "PERMISSIVE").json(path).filter("url IS NOT NULL")
    return tasks if visited is None else tasks.join(visited.select("url").distinct(), "url", "left_anti")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("total_runtime_seconds double").json(path).select(F.coalesce("total_runtime_seconds", F.lit(0.0)).alias("total_runtime_seconds"))


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """A corpus CSV by an explicit schema; missing values are empty strings."""
    return spark.read.options(**_CSV).schema(schema).csv(path).na.fill("")


def scraped_counts(corpus: DataFrame) -> DataFrame:
    """Per label: rows with a sentence and distinct links that are not empty."""
    return corpus.groupBy("Label").agg(F.count_if(trimmed(F.col("Sentence_Unit")) != "").alias("sentences"), F.countDistinct(F.when(F.col("Link") != "", F.col("Link"))).alias("sites"))


def latest_file(spark: SparkSession, pattern: str, fallback: str | None = None) -> str | None:
    """The last path, by name, that a glob pattern matches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((f.getPath().toString() for f in found or []), default=fallback)


# ---- writers ---------------------------------------------------------------------------------------------------------


def write_corpus(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.options(**_CSV).mode(mode).csv(path)


def write_by_class(corpus: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per label below path."""
    corpus.write.options(**_CSV).partitionBy("Label").mode(mode).csv(path)


def write_lines(values: DataFrame, path: str, mode: str = "append") -> None:
    values.write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def prediction_rows(df: DataFrame, probabilities: Column, labels: list[str]) -> DataFrame:
    """Predictions as CSV rows: figures with four decimals."""
    figures = [F.format_string("%.4f", F.get(probabilities, F.lit(i))).alias(f"{name.lower()}_prob") for i, name in enumerate(labels)]
    return df.select("text", "prediction", F.format_string("%.4f", F.array_max(probabilities)).alias("confidence"), *figures)


def archive(spark: SparkSession, path: str, folder: str) -> str | None:
    """Move a file or folder below another, with a running number if its name is taken; the new path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(conf)
    if not system.exists(source):
        return None
    base = jvm.org.apache.hadoop.fs.Path(folder)
    system.mkdirs(base)
    target, n = jvm.org.apache.hadoop.fs.Path(base, source.getName()), 0
    while system.exists(target):
        n += 1
        target = jvm.org.apache.hadoop.fs.Path(base, f"{source.getName()}.{n}")
    if not system.rename(source, target):
        raise OSError(f"can't move {path} to {target}")
    return target.toString()


def drain(spark: SparkSession, buffer: str, drained: str) -> str | None:
    """Take all that a buffer folder holds, at once: it is renamed, so that what comes later starts a new one; the new path."""
    return archive(spark, buffer, drained)


def missing_files(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    return required.select(name).join(present.select(name), name, "left_anti")


def pages_as_tasks(pages: DataFrame) -> DataFrame:
    """A task for each fetched page, for want of a crawl's own table."""
    return pages.select("url", F.lit(0).alias("depth"), F.lit("Web").alias("religion"), F.lit("pages").alias("source"), F.lit("Unknown").alias("region"), url_domain(F.col("url")).alias("domain"), F.lit(0).alias("retry_count"))
