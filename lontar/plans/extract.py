"""The flagship plan: pages to reason-coded, language-gated sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import barrier, spread, trimmed, words
from ..operators.clean import clean_text, presplit_fix, split_sentences
from ..operators.dedup import content_dedup
from ..operators.frontier import min_content
from ..operators.html import dropcap_html_regex, fallback_text
from ..operators.language import gate
from ..operators.rules import ACCEPTED, reason
from ..operators.sentences import clean_sentence


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` in place of the HTML: long enough ones, of equal ones the first."""
    kept = content_dedup(pages.filter(min_content(F.col(html))), html=html)
    return kept.withColumn("text", fallback_text(dropcap_html_regex(F.col(html)))).drop(html)


def cleaned(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with the text cleaned, computed once for all that follows."""
    return barrier(spread(texts), **{text: clean_text(F.col(text))})


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per sentence of the cleaned texts: ``position`` and ``raw``; empty ones go."""
    split = texts.withColumn("_s", split_sentences(presplit_fix(F.col(text)))).drop(text)
    rows = split.select(*[c for c in split.columns if c != "_s"], F.posexplode("_s").alias("position", "raw"))
    return rows.withColumn("raw", trimmed(F.col("raw"))).filter("raw <> ''")


def judged(rows: DataFrame) -> DataFrame:
    """rows with ``sentence`` (cleaned) and its ``reason``; each is computed once."""
    once = barrier(rows, sentence=clean_sentence(F.col("raw"))).drop("raw")
    split = barrier(once, _words=words(F.col("sentence")))
    return barrier(split, reason=reason(F.col("sentence"), F.col("_words"))).drop("_words")


def extract_sentences(texts: DataFrame, detected: Column, targets: tuple[str, ...] = vocab.TARGET_LANGUAGES, text: str = "text") -> DataFrame:
    """Valid sentences with detected_lang and is_target. detected: a column over texts and ``sentence``."""
    good = judged(sentences(cleaned(texts, text))).filter(F.col("reason").isin(*ACCEPTED))
    target, lang = gate(F.col("sentence"), detected, targets)
    return good.withColumn("detected_lang", lang).withColumn("is_target", target)


def target_sentences(texts: DataFrame, detected: Column, targets: tuple[str, ...] = vocab.TARGET_LANGUAGES) -> DataFrame:
    """The sentences of the target languages, alone."""
    return extract_sentences(texts, detected, targets).filter("is_target").select("sentence")
