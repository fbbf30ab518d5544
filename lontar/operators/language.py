"""The language gate. A detector is any column; a native one by frequent words is here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import trimmed, words

#: Frequent function words of the languages that the native detector tells apart.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "mit", "ein", "für"],
    "en": ["the", "and", "of", "to", "is", "that", "was", "with", "for", "on"],
    "es": ["el", "los", "las", "que", "del", "una", "por", "con", "para", "como"],
    "fr": ["le", "les", "des", "est", "une", "dans", "pour", "qui", "sur", "avec"],
    "id": ["yang", "dan", "di", "untuk", "dengan", "ini", "itu", "dari", "adalah", "pada"],
}


def detect_language(text: Column) -> Column:
    """The language with the most different function words (ties: the first by name), unknown if none occurs."""
    w = words(F.lower(text))
    counts = [F.size(F.array_intersect(F.array_distinct(w), F.array(*map(F.lit, ws)))) for ws in STOP_WORDS.values()]
    most = F.greatest(*counts)
    best = F.when(most == 0, "unknown")
    for lang, n in zip(STOP_WORDS, counts, strict=True):
        best = best.when(n == most, lang)
    return best


def gate(text: Column, detected: Column, targets: tuple[str, ...] = vocab.TARGET_LANGUAGES) -> tuple[Column, Column]:
    """(is_target, detected_lang): texts under 15 characters are refused as too short, a null detection as failed."""
    short = F.length(trimmed(F.coalesce(text, F.lit("")))) < 15
    lang = F.when(short, "too_short").otherwise(F.coalesce(detected, F.lit("detection_failed")))
    return lang.isin(*targets) & ~short, lang
