"""The validity cascade: each rule a Boolean column, ``reason`` the first that holds.

A null sentence is an empty one. Rules take the sentence and, if they are at hand, the words of it; a sentence that comes
with its words is a cleaned one, which has no white space at its ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import matches, occurrences, share, trimmed, words
from ..vocab import D, S, W

_UPPER_WORD = r"^\P{Ll}*\p{Lu}\P{Ll}*$"


def _words(s: Column, w: Column | None) -> Column:
    return words(s) if w is None else w


def _bare(s: Column, w: Column | None) -> Column:
    return trimmed(s) if w is None else s


def is_whitelisted(s: Column, w: Column | None = None) -> Column:
    return (F.size(_words(s, w)) <= 5) & matches(F.lower(s), rf"\b(?:{'|'.join(vocab.WHITELIST)})\b")


def is_incomplete_fragment(s: Column, w: Column | None = None) -> Column:
    low = F.lower(_bare(s, w))
    w = _words(s, w)
    n, first = F.size(w), F.lower(F.get(w, F.lit(0)))
    return (
        (n <= 2)
        | low.isin(vocab.CONNECTORS)
        | ((n < 8) & matches(low, rf"^(?:{'|'.join(vocab.CONNECTORS)})"))
        | ((n < 8) & first.isin(vocab.SHORT_CONNECTORS))
        | ((n < 10) & first.isin(vocab.QUESTION_WORDS) & ~F.contains(s, F.lit("?")))
    )


def has_boilerplate(s: Column, w: Column | None = None) -> Column:
    """Any of the phrases, anywhere. They are tried by first letters, at places where one may begin."""
    by_start: dict[str, list[str]] = {}
    for phrase in vocab.BOILERPLATE:
        by_start.setdefault(phrase[:2], []).append(phrase[2:].replace("(", r"\(").replace(")", r"\)"))
    branches = "|".join(f"{start}(?:{'|'.join(rest)})" for start, rest in sorted(by_start.items()))
    first = "".join(sorted({start[0] for start in by_start}))
    return matches(F.lower(s), f"(?=[{first}])(?:{branches})")


def is_address_junk(s: Column, w: Column | None = None) -> Column:
    w = _words(s, w)
    n = F.size(w)
    return (
        matches(s, vocab.ADDRESS)
        | matches(s, vocab.PHONE)
        | matches(s, vocab.PHONE_NUMBER)
        | ((n < 15) & matches(s, vocab.POSTAL_CODE))
        | ((n >= 3) & (share(F.filter(w, lambda x: matches(x, D)), w) > 0.4))
        | ((n < 10) & matches(s, vocab.EMAIL))
    )


def has_bad_concatenation(s: Column, w: Column | None = None) -> Column:
    nav = sum((F.contains(F.upper(s), F.lit(x)).cast("int") for x in vocab.NAV_CAPS), F.lit(0))
    return (
        matches(s, vocab.DATE_CONCAT)
        | matches(s, r"[a-z]{2,}[A-Z]{3,}")
        | matches(s, rf"\.\.[{S}]*[A-Z]")
        | matches(s, r"[A-Z]{4,}[A-Z]{4,}")
        | (occurrences(s, r"\b[A-Z]{3,}\b") >= 3)
        | (occurrences(s, r"[a-z][A-Z][a-z]+[A-Z]") >= 2)
        | matches(s, r"[a-z]{2,}[A-Z][a-z]{2,}")
        | matches(s, r"[A-Z]{3,}[A-Z][a-z]{2,}")
        | (nav >= 2)
    )


def has_weird_ending(s: Column, w: Column | None = None) -> Column:
    s = _bare(s, w)
    return (
        matches(s, rf"\.{D}+\.?$")
        | matches(s, rf"[{S}]{D}{{1,2}}\.?$")
        | matches(s, rf"(?i)\b(?:{'|'.join(vocab.DANGLING)})$")
        | matches(s, rf"[,:][{S}]*[.:!?]?[{S}]*$")
        | matches(s, rf"(?i)(?:{'|'.join(vocab.CUT_ABBREVIATIONS)})\.$")
        | matches(s, r"\([A-Z][a-z]{1,3}\.?$")
        | matches(s, rf"\b[A-Z][a-z]+[{S}]+[A-Z][a-z]?\.$")
        | F.endswith(s, F.lit("("))
    )


def has_weird_start(s: Column, w: Column | None = None) -> Column:
    s = _bare(s, w)
    dash = f"[{vocab.DASH}]"
    return (
        matches(s, r"^[,.;:]")
        | matches(s, rf"^{D}{{1,2}}\.[{S}]")
        | matches(s, r"^(?:\.\.\.|\x{2026})")
        | matches(s, rf"^[A-Z]{{2,5}}[{S}]*[-:]")
        | matches(s, rf"^(?:Com[{S}]*{dash}|Jakarta{dash}|Papua{dash}|[A-Z][a-z]+,[{S}]*[A-Z][a-z]+[{S}]*{dash})")
        | matches(s, rf"^[A-Z][a-z]+(?:[{S}]+[A-Z][a-z]+)*(?:[{S}]*,[{S}]*[A-Z]\.?[{S}]*[A-Z]?\.?)?[{S}]*[|][{S}]*{D}")
        | matches(s, rf"(?i)^\(?[\(\[][{S}]*(?:Ibid|Op\.?[{S}]*cit|Loc\.?[{S}]*cit|cf\.?|p\.|pp\.)")
        | matches(s, r"^(?:\(\(|\[\[)")
        | matches(s, r"^\p{Ll}")
    )


def is_boilerplate_start(s: Column, w: Column | None = None) -> Column:
    return matches(F.lower(_bare(s, w)), vocab.BOILERPLATE_START)


def is_concatenated_menu(s: Column, w: Column | None = None) -> Column:
    w = _words(s, w)
    short = F.filter(w, lambda x: (F.length(x) <= 12) & matches(x, r"^\p{Lu}"))
    return (occurrences(s, "[a-z][A-Z]") >= 3) | ((F.size(w) >= 4) & (share(short, w) > 0.7))


def is_name_list(s: Column, w: Column | None = None) -> Column:
    return matches(s, rf"[A-Z][a-z]+[{S}]+[A-Z][a-z]+-[{S}]*(?:Wil|Section|Bagian)[{S}]+{D}+[{S}]*:[{S}]*(?:Pdt|Dr|Mr|Mrs)") | (
        occurrences(s, rf"[A-Z][a-z]+[{S}]+[A-Z][a-z]+-[{S}]*[{W}]+[{S}]+{D}+[{S}]*:") >= 2
    )


def has_metadata_signature(s: Column, w: Column | None = None) -> Column:
    return matches(s, vocab.METADATA_SIGNATURE)


def is_schedule_fragment(s: Column, w: Column | None = None) -> Column:
    return matches(s, rf":[{S}]*{D}{{1,2}}[.:]{D}{{2}}") & (F.size(_words(s, w)) < 15)


def is_names_only(s: Column, w: Column | None = None) -> Column:
    w = _words(s, w)
    n, last = F.size(w), F.element_at(w, -1)
    names = F.size(F.filter(w, lambda x: matches(x, r"^\p{Lu}"))) >= n * 0.75
    shape = matches(s, rf"^[A-Z][a-z]*\.?[{S}]+[A-Z]") | matches(s, rf"\([a-z]+\)[{S}]*$")
    fragment = matches(s, rf"^[A-Z][a-z]+[{S}]+[a-z]+[{S}]+[A-Z][a-z]+")
    ending = F.lower(last).isin(vocab.NAME_ENDINGS) | F.endswith(last, F.lit("."))
    return (n > 0) & (((n <= 4) & names & shape) | ((n <= 6) & fragment & ending))


def has_high_nav_density(s: Column, w: Column | None = None) -> Column:
    w = _words(s, w)
    return share(F.filter(w, lambda x: F.lower(x).isin(vocab.NAV_DENSITY)), w) > 0.30


def has_high_caps_density(s: Column, w: Column | None = None) -> Column:
    w = _words(s, w)
    caps = F.filter(w, lambda x: (F.length(x) > 1) & matches(x, _UPPER_WORD))
    return (F.size(w) > 6) & (share(caps, w) > 0.60)


def has_improper_start(s: Column, w: Column | None = None) -> Column:
    return ~matches(s, r"^[\p{Lu}\x{22}\x{27}\(]")


#: Reason, rule: in the order in which they are tried. ``whitelisted`` accepts, the others refuse.
CASCADE = [
    ("empty_after_clean", lambda s, w=None: s == ""),
    ("too_short_chars", lambda s, w=None: F.length(s) < vocab.MIN_CHARS),
    ("too_long_chars", lambda s, w=None: F.length(s) > vocab.MAX_CHARS),
    ("too_few_words", lambda s, w=None: F.size(_words(s, w)) < vocab.MIN_WORDS),
    ("too_many_words", lambda s, w=None: F.size(_words(s, w)) > vocab.MAX_WORDS),
    ("whitelisted", is_whitelisted),
    ("incomplete_fragment", is_incomplete_fragment),
    ("boilerplate", has_boilerplate),
    ("address_junk", is_address_junk),
    ("bad_concatenation", has_bad_concatenation),
    ("weird_ending", has_weird_ending),
    ("weird_start", has_weird_start),
    ("boilerplate_start", is_boilerplate_start),
    ("concatenated_menu", is_concatenated_menu),
    ("name_list", is_name_list),
    ("metadata_signature", has_metadata_signature),
    ("schedule_fragment", is_schedule_fragment),
    ("names_only", is_names_only),
    ("high_nav_density", has_high_nav_density),
    ("high_caps_density", has_high_caps_density),
    ("improper_start", has_improper_start),
]
ACCEPTED = ("valid", "whitelisted")


def reason(sentence: Column, w: Column | None = None) -> Column:
    """The reason code of a cleaned sentence. w: its words, so that they are not split anew by every rule."""
    if w is None:
        sentence = F.coalesce(sentence, F.lit(""))
    first = None
    for name, rule in CASCADE:
        first = F.when(rule(sentence, w), name) if first is None else first.when(rule(sentence, w), name)
    return first.otherwise("valid")
