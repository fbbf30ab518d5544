"""Cleaning of sentences: one operator per step, ``clean_sentence`` for all in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import guarded, matches, substituted, words


def cs_title_paren(text: Column) -> Column:
    """Parentheses of 20 characters or more that read like a title become a space.

    They are found once; each goes where it first occurs."""

    def title(m: Column) -> Column:
        content = F.substring(m, F.lit(2), F.length(m) - 2)
        w = words(content)
        capital = F.filter(w, lambda x: matches(x, r"^\p{Lu}"))
        return (F.size(w) >= 4) & (F.size(capital) >= F.size(w) * 0.6) & ~matches(content, rf"[{vocab.D}:]")

    def without(text: Column, m: Column) -> Column:
        at = F.instr(text, m)
        return F.when(title(m) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(m), F.length(text)))).otherwise(text)

    return F.aggregate(F.regexp_extract_all(text, F.lit(vocab.TITLE_PAREN), F.lit(0)), text, without)


def _holds(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = F.contains(text, F.lit(parts[0]))
        for part in parts[1:]:
            found = found | F.contains(text, F.lit(part))
        return found

    return test


_PAREN, _DASHES = _holds("("), _holds("-", "–", "—")
#: What a text must hold for a step to change it.
NEEDS = {
    "cs_url": lambda t: matches(t, rf"\.[^{vocab.S}]|://"),
    "cs_lead_citation": _PAREN,
    "cs_lead_partial_citation": _PAREN,
    "cs_verse": _PAREN,
    "cs_abbrev_ref": _PAREN,
    "cs_num_paren": _PAREN,
    "cs_title_paren": _PAREN,
    "cs_com_prefix": _holds("Com"),
    "cs_dateline": _DASHES,
    "cs_dashes": _DASHES,
    "cs_author_date": _holds("|"),
    "cs_ellipsis_marker": _holds("["),
    "cs_bank": _holds(":"),
    "cs_separator": _holds("===", "---", "***", "=-", "-=", "=*", "*=", "-*", "*-"),
    "cs_read_online": _holds(":", "|"),
    "cs_name_list": _holds("Wil"),
    "cs_copyright": _holds("©"),
    "cs_space_paren": _holds(")"),
    "cs_space_colon": _holds(":"),
    "cs_list_marker": _holds(":", "#"),
    "cs_inner_quotes": _holds('"', "'"),
}


def step(name: str, text: Column) -> Column:
    """One step of vocab.SENTENCE_STEPS."""
    change = cs_title_paren if name == "cs_title_paren" else lambda t: substituted(t, vocab.SENTENCE_STEPS[name])
    return guarded(text, NEEDS[name], change) if name in NEEDS else change(text)


def clean_sentence(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for name in vocab.SENTENCE_STEPS:
        text = step(name, text)
    return text
