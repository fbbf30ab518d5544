"""Host-level quality rules.

Every document is measured by whole-text rules; the failures of each rule are summed by host (the ``source``
of a document), each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts, and
hosts whose shrunk rate is too high take their documents with them.

Null texts are empty documents (no word, so they fail). Documents without a host form none: only their own
rules apply. Empty tables give empty results; repeated rows are judged each for itself and count each for the
host; columns other than the three named ones play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lookup, read_table, small, stored, text_bytes

MIN_WORDS = 50
#: A host is refused if its shrunk rate of failures under a rule is above this.
HOST_RATES = {"base": 0.5, "symbols": 0.5, "dup_lines": 0.5}

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character
_SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        duplicates,
        repeated_words(words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], ["doc_id", "host", *FEATURES])


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def _rules() -> dict:
    """The rules that hosts are judged by, as Boolean columns over the features."""
    return {
        "base": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 50 * F.col("n_dup_lines") > F.greatest(F.col("n_words"), F.lit(1)),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row per document: its id, host and features."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_bytes(text_col).alias("text"))
    return narrow.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{c} long" for c in FEATURES))


def beta_prior(k: int, n: float, n2: float, x: float, q: float) -> tuple[float, float]:
    """Mean and strength from the hosts' number, documents, their squares, failures, and failures' squares by documents."""
    m = x / n if n else 0.0
    free = n - n2 / n - (k - 1) if n else 0.0
    c = ((q - n * m * m) / (m * (1 - m)) - (k - 1)) / free if free > 0 and 0 < m < 1 else 0.0
    return m, 1 / min(max(c, 1e-6), 0.99) - 1


def host_verdicts(features: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Per host: documents, failures and shrunk rate of each rule, and whether it is refused.

    A host's failures are taken as beta-binomial, and a rule's prior is fitted to all hosts by moments that are weighted by
    their documents: with k hosts of n_i documents, N in all, and mean rate m, the sum S of n_i (rate - m)^2 is expected to be
    m (1 - m) (k - 1 + c (N - sum n_i^2 / N - k + 1)), where c is the correlation of a host's documents. What small hosts
    differ by chance is thus not taken for a difference between hosts. The prior's strength is 1 / c - 1, with c held
    between 1e-6 and 0.99 (the lower end too where nothing tells, as with one document a host). It is one row, whatever the
    number of hosts.
    """
    rates = rates or HOST_RATES
    rules = _rules()
    hosts = (
        features.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), *[F.sum(rules[r].cast("long")).alias(f"{r}_failed") for r in rates])
    )
    hosts = stored(hosts, "hosts")
    n, x = F.col("n_docs").cast("double"), {r: F.col(f"{r}_failed").cast("double") for r in rates}
    moments = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), *[y for r in rates for y in (F.sum(x[r]).alias(f"{r}_x"), F.sum(x[r] * x[r] / n).alias(f"{r}_q"))]).first()
    out, refused = hosts, F.lit(False)
    for r, most in rates.items():
        m, strength = beta_prior(moments["k"], moments["n"] or 0.0, moments["n2"] or 0.0, moments[f"{r}_x"] or 0.0, moments[f"{r}_q"] or 0.0)
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + m * strength) / (F.col("n_docs") + strength))
        refused = refused | (F.col(f"{r}_rate") > most)
    return out.select("host", "n_docs", *[x for r in rates for x in (f"{r}_failed", f"{r}_rate")], refused.alias("host_refused"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rates: dict[str, float] | None = None) -> DataFrame:
    """Features and verdicts of every document: FEATURES, ``base_failed``, ``host_refused``, ``kept``.

    Texts are read once; the narrow features are stored, so that judging hosts and joining them back don't read them again.
    """
    features = stored(measured(docs, id_col, text_col, host_col), "quality")
    hosts = stored(host_verdicts(features, rates).select("host", "host_refused"), "hosts")
    joined = lookup(features, hosts, "host").withColumn("base_failed", _rules()["base"])
    return joined.select(
        "doc_id",
        *FEATURES,
        "base_failed",
        F.coalesce("host_refused", F.lit(False)).alias("host_refused"),
        (~F.col("base_failed") & ~F.coalesce("host_refused", F.lit(False))).alias("kept"),
    )


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = batch.column("_text_bytes").to_pylist()
        keep = []
        for t in texts:
            words = t.split()
            keep.append(len(words) >= MIN_WORDS and not base_failed(len(words), repeated_words(words)))
        yield batch.drop_columns(["_text_bytes"]).filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rates: dict[str, float] | None = None) -> DataFrame:
    """The documents that pass their own rules and whose host does, with all their columns.

    The documents are filtered in place, then joined to the refused hosts, a list that is broadcast if it is counted small.
    """
    features = stored(measured(docs, id_col, text_col, host_col), "quality")
    refused = stored(host_verdicts(features, rates).filter("host_refused").select(F.col("host").alias("_host")), "hosts")
    passing = docs.withColumn("_text_bytes", text_bytes(text_col)).mapInArrow(_passing, docs.schema)
    return lookup(passing.withColumn("_host", F.col(host_col).cast("string")), refused, "_host", "left_anti").select(*docs.columns)


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select("doc_id", *FEATURES, "base_failed", "kept")


#: The same in DuckDB; windows, lines and hosts are relations there.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, range(1, len(ws) - 1) t(i)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 3) t(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
f AS (
  SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN dup ON w.r = dup.r),
j AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, 10 * n_symbols > word_chars AS symbols_failed,
  50 * n_dup_lines > greatest(n_words, 1) AS lines_failed FROM f),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3]) AS rule, unnest([sum(base_failed::INT), sum(symbols_failed::INT), sum(lines_failed::INT)]) AS failed
  FROM j WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT rule, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS n2, sum(failed)::DOUBLE AS x, sum(failed::DOUBLE * failed / n) AS q FROM h GROUP BY rule),
c AS (SELECT rule, x / n AS m, CASE WHEN n - n2 / n - (k - 1) > 0 AND x > 0 AND x < n
  THEN ((q - x * x / n) / (x / n * (1 - x / n)) - (k - 1)) / (n - n2 / n - (k - 1)) ELSE 0 END AS c FROM m),
s AS (SELECT rule, m, 1 / least(greatest(c, 1e-6), 0.99) - 1 AS strength FROM c),
bad AS (SELECT source, bool_or((failed + m * strength) / (n + strength) > 0.5) AS refused FROM h JOIN s ON h.rule = s.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(refused, false)) AS kept
FROM j LEFT JOIN bad ON j.source = bad.source
"""
