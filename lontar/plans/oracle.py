"""DuckDB SQL for text rules: what the queries are held against. It shares the fixed patterns, not the plans."""

from __future__ import annotations

from .. import vocab
from ..vocab import D, S, W

#: Runs of word characters beyond ASCII. RE2 knows word boundaries of ASCII only; between underscores such runs are words to it.
_FOREIGN = r"[^\x00-\x7F\pZ\pP\pS\pC]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(new.replace('$', chr(92)))}, 'g')"
    return x


def bounded(x: str, steps: list[tuple[str, str]]) -> str:
    """rep with patterns that hold word boundaries."""
    return rep(rep(rep(x, [(f"({_FOREIGN})", "_$1_")]), steps), [(f"_({_FOREIGN})_", "$1")])


def has(x: str, pattern: str) -> str:
    if r"\b" in pattern:
        x = rep(x, [(f"({_FOREIGN})", "_$1_")])
    return f"regexp_matches({x}, {lit(pattern)})"


def count(x: str, pattern: str) -> str:
    if r"\b" in pattern:
        x = rep(x, [(f"({_FOREIGN})", "_$1_")])
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(f'[{S}]+')}), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def trimmed(x: str) -> str:
    return rep(x, [(rf"^[{S}]+|[{S}]+$", "")])


def some(names: list[str]) -> str:
    return "(" + ", ".join(map(lit, names)) + ")"


def share(x: str, condition: str) -> str:
    return f"(CASE WHEN {n_words(x)} > 0 THEN len(list_filter({words(x)}, lambda v: {condition})) / {n_words(x)} ELSE 0.0 END)"


# ---- whole texts -----------------------------------------------------------------------------------------------------


def fix_mojibake(x: str) -> str:
    for bad, good in vocab.MOJIBAKE:
        if bad != "\x00":  # no text holds it here, and a literal can't
            x = f"replace({x}, {lit(bad)}, {lit(good)})"
    return x


CLEAN = {
    "fix_mojibake": fix_mojibake,
    "fix_dropcap_words": lambda x: bounded(x, [(rf"(?i)\b{a}\b", b) for a, b in vocab.DROPCAP_WORDS]),
    "protect_titles": lambda x: bounded(x, [(rf"\b{t}\.", t) for t in vocab.TITLES]),
    "strip_nav_keywords": lambda x: bounded(x, [(rf"(?i)\b{k}\b", "") for k in vocab.NAV_KEYWORDS]),
    "strip_bible_refs": lambda x: bounded(x, [(vocab.BIBLE_REF, "")]),
    "strip_quran_refs": lambda x: bounded(x, [(vocab.QURAN_REF, "")]),
    "strip_metadata": lambda x: rep(x, [(p, "") for p in vocab.METADATA_TAILS]),
    "strip_arabic": lambda x: rep(x, [(vocab.ARABIC, " ")]),
    "normalize_quotes": lambda x: f"translate({x}, '–—', '--')",
    "strip_control": lambda x: rep(x, [(r"\p{C}", "")]),
    "collapse_space": lambda x: trimmed(rep(x, [(r"[ \t]+", " ")])),
}


def staged(source: str, key: str, x: str, steps: list, name: str) -> tuple[str, str]:
    """CTEs that apply steps to column x of source one after the other; (the CTEs, the last one's name)."""
    out, last = [], source
    for i, step in enumerate(steps):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT {key}, {step(x)} AS {x} FROM {last})")
        last = f"{name}{i}"
    return ",\n".join(out), last


def presplit(x: str) -> str:
    return rep(x, [(rf"\.\.+[{S}]*", ". "), (r"([.!?])([A-Z])", "$1 $2")])


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {lit(rf'([.!?])[{S}]+')}, {lit(chr(92) + '1' + chr(1))}, 'g')"
    return f"string_split({marked}, {lit(chr(1))})"


# ---- sentences -------------------------------------------------------------------------------------------------------


def title_paren(x: str) -> str:
    content = "m[2:-2]"
    title = f"({n_words(content)} >= 4 AND len(list_filter({words(content)}, lambda w2: regexp_matches(w2, '^\\p{{Lu}}'))) >= {n_words(content)} * 0.6 AND NOT {has(content, rf'[{D}:]')})"
    cut = f"(CASE WHEN {title} AND instr(acc, m) > 0 THEN substr(acc, 1, instr(acc, m) - 1) || ' ' || substr(acc, instr(acc, m) + length(m)) ELSE acc END)"
    return f"list_reduce(list_prepend({x}, regexp_extract_all({x}, {lit(vocab.TITLE_PAREN)})), lambda acc, m: {cut})"


def sentence_step(name: str):
    if name == "cs_title_paren":
        return title_paren
    steps = vocab.SENTENCE_STEPS[name]
    return (lambda x: bounded(x, steps)) if any(r"\b" in p for p, _ in steps) else (lambda x: rep(x, steps))


def _weird_start(s: str) -> str:
    s, dash = trimmed(s), f"[{vocab.DASH}]"
    return " OR ".join(
        has(s, p)
        for p in (
            r"^[,.;:]", rf"^{D}{{1,2}}\.[{S}]", r"^(?:\.\.\.|\x{2026})", rf"^[A-Z]{{2,5}}[{S}]*[-:]",
            rf"^(?:Com[{S}]*{dash}|Jakarta{dash}|Papua{dash}|[A-Z][a-z]+,[{S}]*[A-Z][a-z]+[{S}]*{dash})",
            rf"^[A-Z][a-z]+(?:[{S}]+[A-Z][a-z]+)*(?:[{S}]*,[{S}]*[A-Z]\.?[{S}]*[A-Z]?\.?)?[{S}]*[|][{S}]*{D}",
            rf"(?i)^\(?[\(\[][{S}]*(?:Ibid|Op\.?[{S}]*cit|Loc\.?[{S}]*cit|cf\.?|p\.|pp\.)", r"^(?:\(\(|\[\[)", r"^\p{Ll}",
        )
    )


def _weird_ending(s: str) -> str:
    s = trimmed(s)
    return " OR ".join(
        has(s, p)
        for p in (
            rf"\.{D}+\.?$", rf"[{S}]{D}{{1,2}}\.?$", rf"(?i)\b(?:{'|'.join(vocab.DANGLING)})$", rf"[,:][{S}]*[.:!?]?[{S}]*$", rf"(?i)(?:{'|'.join(vocab.CUT_ABBREVIATIONS)})\.$",
            r"\([A-Z][a-z]{1,3}\.?$", rf"\b[A-Z][a-z]+[{S}]+[A-Z][a-z]?\.$", r"\($",
        )
    )


def _fragment(s: str) -> str:
    low = trimmed(f"lower({s})")
    n, first = n_words(low), f"{words(low)}[1]"
    return (
        f"{n} <= 2 OR {low} IN {some(vocab.CONNECTORS)} OR ({n} < 8 AND {has(low, '^(?:' + '|'.join(vocab.CONNECTORS) + ')')}) OR ({n} < 8 AND {first} IN {some(vocab.SHORT_CONNECTORS)}) "
        f"OR ({n} < 10 AND {first} IN {some(vocab.QUESTION_WORDS)} AND NOT contains({s}, '?'))"
    )


def _names_only(s: str) -> str:
    n, last = n_words(s), f"{words(s)}[-1]"
    capital = f"len(list_filter({words(s)}, lambda v: regexp_matches(v, '^\\p{{Lu}}'))) >= {n} * 0.75"
    shape = f"({has(s, rf'^[A-Z][a-z]*\.?[{S}]+[A-Z]')} OR {has(s, rf'\([a-z]+\)[{S}]*$')})"
    part = has(s, rf"^[A-Z][a-z]+[{S}]+[a-z]+[{S}]+[A-Z][a-z]+")
    return f"{n} > 0 AND (({n} <= 4 AND {capital} AND {shape}) OR ({n} <= 6 AND {part} AND (lower({last}) IN {some(vocab.NAME_ENDINGS)} OR ends_with({last}, '.'))))"


RULES = {
    "empty_after_clean": lambda s: f"{s} = ''",
    "too_short_chars": lambda s: f"length({s}) < {vocab.MIN_CHARS}",
    "too_long_chars": lambda s: f"length({s}) > {vocab.MAX_CHARS}",
    "too_few_words": lambda s: f"{n_words(s)} < {vocab.MIN_WORDS}",
    "too_many_words": lambda s: f"{n_words(s)} > {vocab.MAX_WORDS}",
    "whitelisted": lambda s: f"{n_words(s)} <= 5 AND {has(f'lower({s})', rf'\b(?:{'|'.join(vocab.WHITELIST)})\b')}",
    "incomplete_fragment": _fragment,
    "boilerplate": lambda s: "(" + " OR ".join(f"contains(lower({s}), {lit(p)})" for p in vocab.BOILERPLATE) + ")",
    "address_junk": lambda s: (
        f"{has(s, vocab.ADDRESS)} OR {has(s, vocab.PHONE)} OR {has(s, vocab.PHONE_NUMBER)} OR ({n_words(s)} < 15 AND {has(s, vocab.POSTAL_CODE)}) "
        f"OR ({n_words(s)} >= 3 AND {share(s, f'regexp_matches(v, {lit(D)})')} > 0.4) OR ({n_words(s)} < 10 AND {has(s, vocab.EMAIL)})"
    ),
    "bad_concatenation": lambda s: (
        f"{has(s, vocab.DATE_CONCAT)} OR {has(s, '[a-z]{2,}[A-Z]{3,}')} OR {has(s, rf'\.\.[{S}]*[A-Z]')} OR {has(s, '[A-Z]{4,}[A-Z]{4,}')} OR {count(s, r'\b[A-Z]{3,}\b')} >= 3 "
        f"OR {count(s, '[a-z][A-Z][a-z]+[A-Z]')} >= 2 OR {has(s, '[a-z]{2,}[A-Z][a-z]{2,}')} OR {has(s, '[A-Z]{3,}[A-Z][a-z]{2,}')} OR "
        + " + ".join(f"contains(upper({s}), {lit(x)})::INT" for x in vocab.NAV_CAPS)
        + " >= 2"
    ),
    "weird_ending": _weird_ending,
    "weird_start": _weird_start,
    "boilerplate_start": lambda s: has(trimmed(f"lower({s})"), vocab.BOILERPLATE_START),
    "concatenated_menu": lambda s: f"{count(s, '[a-z][A-Z]')} >= 3 OR ({n_words(s)} >= 4 AND {share(s, 'length(v) <= 12 AND ' + has('v', '^' + chr(92) + 'p{Lu}'))} > 0.7)",
    "name_list": lambda s: (
        f"{has(s, rf'[A-Z][a-z]+[{S}]+[A-Z][a-z]+-[{S}]*(?:Wil|Section|Bagian)[{S}]+{D}+[{S}]*:[{S}]*(?:Pdt|Dr|Mr|Mrs)')} OR {count(s, rf'[A-Z][a-z]+[{S}]+[A-Z][a-z]+-[{S}]*[{W}]+[{S}]+{D}+[{S}]*:')} >= 2"
    ),
    "metadata_signature": lambda s: has(s, vocab.METADATA_SIGNATURE),
    "schedule_fragment": lambda s: f"{has(s, rf':[{S}]*{D}{{1,2}}[.:]{D}{{2}}')} AND {n_words(s)} < 15",
    "names_only": _names_only,
    "high_nav_density": lambda s: f"{share(f'lower({s})', f'v IN {some(vocab.NAV_DENSITY)}')} > 0.30",
    "high_caps_density": lambda s: f"{n_words(s)} > 6 AND {share(s, 'length(v) > 1 AND ' + has('v', r'^\P{Ll}*\p{Lu}\P{Ll}*$'))} > 0.60",
    "improper_start": lambda s: f"NOT {has(s, r'^[\p{Lu}\x{22}\x{27}\(]')}",
}


def reason(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {rule(s)} THEN '{name}'" for name, rule in RULES.items()) + " ELSE 'valid' END"


# ---- pages and URLs --------------------------------------------------------------------------------------------------


def fallback_text(x: str) -> str:
    steps = [(rf"(?is)<{t}\b[^>]*>.*?</{t}[^>]*>", " ") for t in vocab.HIDDEN_ELEMENTS if t != "input"]
    x = rep(x, [*steps, (r"(?i)<input\b[^>]*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")])
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def url_domain(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def url_path(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def url_normalize(x: str) -> str:
    return rep(f"split_part({x}, '#', 1)", [("/+$", ""), (vocab.TRACKING, "")])


def url_trap(x: str) -> str:
    path = url_path(x)
    low, parts = f"lower({path})", f"list_filter(string_split({path}, '/'), lambda p: p <> '')"
    twice = f"len(list_filter(list_zip({parts}[:-2], {parts}[2:]), lambda z: z[1] = z[2])) > 0"
    return (
        f"({has(low, rf'\.(?:{'|'.join(vocab.SKIPPED_EXTENSIONS)})$')} OR len({parts}) > {vocab.MAX_SEGMENTS} OR {twice} OR {has(path, '/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{4}/')} OR "
        + " OR ".join(f"contains({low}, {lit(f)})" for f in vocab.SKIPPED_FRAGMENTS)
        + ")"
    )


def url_resolve(href: str, base: str) -> str:
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    folder = f"{origin} || CASE WHEN {url_path(base)} = '' THEN '/' ELSE regexp_replace({url_path(base)}, '[^/]*$', '') END"
    return (
        f"CASE WHEN {has(href, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN {href} WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {href} "
        f"WHEN starts_with({href}, '/') THEN {origin} || {href} WHEN starts_with({href}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {href} ELSE {folder} || {href} END"
    )


def links(source: str = "pages") -> str:
    skipped = " OR ".join(f"starts_with(href, {lit(s)})" for s in vocab.SKIPPED_SCHEMES)
    pattern = lit(r"""(?i)href=["']([^"']+)["']""")
    return (
        f"SELECT DISTINCT url, link FROM (SELECT url, {url_normalize(url_resolve('href', 'url'))} AS link FROM (SELECT url, unnest(regexp_extract_all(html, {pattern}, 1)) AS href FROM {source}) WHERE NOT ({skipped})) "
        f"WHERE ({url_domain('link')} = {url_domain('url')} OR ends_with({url_domain('link')}, '.' || {url_domain('url')})) AND NOT {url_trap('link')}"
    )
