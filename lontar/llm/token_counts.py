"""Token counts through a digest cache.

A text's content digest (SHA-256 of the UTF-8 bytes of its normal form) and the digest of the tokenizer file identify a
count. The normal form is what the tokenizer's own normaliser makes of the text, so that it keeps the count (the byte-level
one has none: there it is the text itself, null as empty); a text that holds one of the tokenizer's special strings, in
any case, is its own normal form, as those are looked for before. Digests are joined to the counts stored before; of the
texts that miss, each distinct one is encoded once, and its count is appended to the cache. Appending writes new files only, so tasks that run twice or jobs at the same time
do no harm: equal keys hold equal counts, and readers take one.

Null and empty texts have no tokens; repeated rows give repeated results; null ids stay null; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder
from .shared import read_table, small, stored, workspace

LIMIT = 512
_SCHEMA = "digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def normaliser(path: str) -> Callable[[str], str] | None:
    """Makes normal forms; None if every text is its own."""
    if path.endswith(".model"):
        import sentencepiece

        return getattr(sentencepiece.SentencePieceProcessor(model_file=path), "normalize", None)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    if model.normalizer is None:
        return None
    special = [t.content.lower() for t in model.get_added_tokens_decoder().values()]

    def normal(text: str) -> str:
        form = model.normalizer.normalize_str(text)
        return text if any(x in text.lower() or x in form.lower() for x in special) else form

    return normal


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = normaliser(path)
        for batch in small(batches):
            digests = [hashlib.sha256(normal(t).encode()).digest() for t in batch.column("content").to_pylist()]
            yield batch.append_column("digest", pa.array(digests, pa.binary()))

    return digest


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = encoder(path).counts
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts(batch.column("content")))], ["digest", "n_tokens"])

    return count


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row. tokenizer: a vocabulary file; cache: the cache's folder, made if it isn't there."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content"))
    if normaliser(tokenizer) is None:
        given = given.withColumn("digest", F.unhex(F.sha2("content", 256)))
    else:
        given = given.mapInArrow(_digester(tokenizer), "doc_id long, content string, digest binary")
    at = f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}"
    # The distinct texts: equal ones meet in the map tasks first, so a text that a third of the rows hold is no hot group.
    distinct = given.select("digest", "content").groupBy("digest").agg(F.first("content").alias("content"))
    if _exists(spark, at):
        distinct = distinct.join(spark.read.schema(_SCHEMA).parquet(at).select("digest").distinct(), "digest", "left_anti")
    distinct.mapInArrow(_counter(tokenizer), _SCHEMA).write.mode("append").parquet(at)
    # Stored, so that the join below deals out both of its sides itself and can split a digest that many rows have.
    counts = stored(spark.read.schema(_SCHEMA).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    narrow = given.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every call does the whole work."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts(read_table(spark, sf_dir, "documents"), path, workspace(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
