"""Cleaning of whole texts. Each step is an operator; ``clean_text`` is all of them in order.

Null texts are empty ones. Deleting control characters glues lines together; the rules on sentences rely on it
(``newline_to_space`` gives the other form).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import guarded, matches, substituted, trimmed


def _any_word(words: list[str]) -> str:
    """A pattern for any of the words, tried at places where one may begin."""
    first = "".join(sorted({w[0] for w in words}))
    return rf"(?i)\b(?=[{first}])(?:{'|'.join(words)})\b"


def fix_mojibake(text: Column) -> Column:
    """Every pair begins with one of five characters, so most texts need one look only."""

    def replaced(t: Column) -> Column:
        for bad, good in vocab.MOJIBAKE:
            t = F.replace(t, F.lit(bad), F.lit(good))
        return t

    return guarded(text, lambda t: matches(t, r"[\x{e2}\x{c2}\x{c3}\x{00}\x{feff}]|&nbsp;"), replaced)


def fix_dropcap_words(text: Column) -> Column:
    steps = [(rf"(?i)\b{cut}\b", whole) for cut, whole in vocab.DROPCAP_WORDS]
    return guarded(text, lambda t: matches(t, _any_word([cut for cut, _ in vocab.DROPCAP_WORDS])), lambda t: substituted(t, steps))


def protect_titles(text: Column) -> Column:
    """One by one: in a chain such as ``Dr.H.`` removing the first dot hides the second title."""
    steps = [(rf"\b{t}\.", t) for t in vocab.TITLES]
    return guarded(text, lambda t: matches(t, rf"\b(?:{'|'.join(vocab.TITLES)})\."), lambda t: substituted(t, steps))


def strip_nav_keywords(text: Column) -> Column:
    steps = [(rf"(?i)\b{k}\b", "") for k in vocab.NAV_KEYWORDS]
    return guarded(text, lambda t: matches(t, _any_word(vocab.NAV_KEYWORDS)), lambda t: substituted(t, steps))


def strip_bible_refs(text: Column) -> Column:
    return guarded(text, lambda t: matches(t, vocab.D), lambda t: substituted(t, [(vocab.BIBLE_REF, "")]))


def strip_quran_refs(text: Column, require_number: bool = False) -> Column:
    """Without require_number, any word that begins with one of the prefixes goes, as its numbers are optional."""
    return substituted(text, [(vocab.QURAN_REF_NUMBERED if require_number else vocab.QURAN_REF, "")])


def strip_metadata(text: Column) -> Column:
    steps = [(p, "") for p in vocab.METADATA_TAILS]
    return guarded(text, lambda t: matches(t, r"(?i)[|\x{a9}]|copyright|all rights|hak cipta"), lambda t: substituted(t, steps))


def strip_arabic(text: Column) -> Column:
    return substituted(text, [(vocab.ARABIC, " ")])


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, "–—", "--")


def strip_control(text: Column, newline_to_space: bool = False) -> Column:
    if newline_to_space:
        text = F.regexp_replace(text, r"[\r\n\t]+", " ")
    return F.regexp_replace(text, r"\p{C}", "")


def collapse_space(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[ \t]+", " "))


STEPS = [
    fix_mojibake, fix_dropcap_words, protect_titles, strip_nav_keywords, strip_bible_refs, strip_quran_refs, strip_metadata, strip_arabic, normalize_quotes, strip_control, collapse_space,
]


def clean_text(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for step in STEPS:
        text = step(text)
    return text


def presplit_fix(text: Column) -> Column:
    return substituted(text, [(rf"\.\.+[{vocab.S}]*", ". "), (r"([.!?])([A-Z])", "$1 $2")])


def split_sentences(text: Column) -> Column:
    """An array of sentences, which keep their final marks."""
    return F.split(F.regexp_replace(text, rf"([.!?])[{vocab.S}]+", "$1\u0001"), "\u0001")
