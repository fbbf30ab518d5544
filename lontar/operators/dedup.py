"""First-wins deduplication. Only keys and order are dealt out where that is enough to decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_dedup(pages: DataFrame, order: str = "page_id", html: str = "html") -> DataFrame:
    """Of pages with equal HTML, the one that comes first; null pages are all kept.

    The first of each digest is a minimum, taken where the rows lie before they move: no digest is a hot key, and the
    pages themselves are dealt out only for the join that keeps the firsts, by their own order column.
    """
    firsts = pages.filter(F.col(html).isNotNull()).groupBy(F.md5(html).alias("_hash")).agg(F.min(order).alias(order)).select(order)
    return pages.join(firsts, order, "left_semi").union(pages.filter(F.col(html).isNull()))


def sentence_dedup(sentences: DataFrame) -> DataFrame:
    """A text once per URL; the same text on other URLs stays."""
    first = F.row_number().over(Window.partitionBy("url", F.xxhash64("sentence"), "sentence").orderBy("position"))
    return sentences.withColumn("_n", first).filter("_n = 1").drop("_n")


def route(sentences: DataFrame, target: str = "is_target") -> tuple[DataFrame, DataFrame]:
    """Accepted and refused sentences; where the language is not known, a sentence is accepted."""
    known = F.coalesce(F.col(target), F.lit(True))
    return sentences.filter(known), sentences.filter(~known)
