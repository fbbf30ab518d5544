"""From documents to training sequences, in five stages.

1. quality rules: documents that their own rules or their host's verdict reject go;
2. near duplicates: of documents that SimHash links connect, the one with the smallest doc_id stays;
3. repeated passages: windows of 13 words that a document with a smaller doc_id has are taken out of the text;
4. personal data: every span is replaced by its kind;
5. packing: what is left becomes pieces of sequences.

Each stage works on what its predecessor kept, reads whole texts, and (but for the last) returns the columns of
``documents``; n_chars follows the text. Null texts, texts without words, ties, repeated rows and empty tables are
handled as the stages' operators say: quality rules drop empty documents, and later stages keep what they are given.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lontar.llm.packing import harmonic_packing
from lontar.llm.pii import redacted
from lontar.llm.quality import keep_good
from lontar.llm.shared import discard, made, read_table, stored
from lontar.llm.simhash import keep_one
from lontar.llm.substrings import without_repeats

_tables: list[str] = []


def stage(f):
    """A stage that removes the intermediate tables of the stage called before it: what that one returned is written by
    then, as every stage's result is written and read again before the next stage gets it."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(_tables)
        _tables.clear()
        before = set(made())
        out = f(spark, docs, sf_dir)
        _tables.extend(path for path in made() if path not in before)
        return out

    return call


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, count_col="n_chars")


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs, count_col="n_chars")


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints, span models and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stored(apply(spark, docs, sf_dir), name, "snappy")
    return docs
