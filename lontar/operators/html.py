"""HTML to text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab
from ..functions.text import substituted

#: Entities that the native form decodes; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
_HIDDEN = [(rf"(?is)<{t}\b[^>]*>.*?</{t}[^>]*>", " ") for t in vocab.HIDDEN_ELEMENTS if t != "input"]
_TAGS = [(r"(?i)<input\b[^>]*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")]


def dropcap_html_regex(html: Column) -> Column:
    """Initials in elements of their own join the word that follows."""
    return substituted(html, vocab.DROPCAP_HTML)


def fallback_text(html: Column) -> Column:
    """The text outside of hidden elements: scripts and styles go before tags, as they may hold what looks like one."""
    text = substituted(F.coalesce(html, F.lit("")), [*_HIDDEN, *_TAGS])
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


class _Tree(HTMLParser):
    """Events of a page as a list: (kind, tag, attributes, raw text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.events: list[list] = []
        self.feed(html)
        self.close()

    def _add(self, kind: str, tag: str = "", attributes: list | None = None, raw: str = "") -> None:
        self.events.append([kind, tag, dict(attributes or []), raw])

    def handle_starttag(self, tag, attrs):
        self._add("start", tag, attrs, self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self._add("void", tag, attrs, self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        self._add("end", tag, raw=f"</{tag}>")

    def handle_data(self, data):
        self._add("text", raw=data)

    def handle_entityref(self, name):
        self._add("text", raw=f"&{name};")

    def handle_charref(self, name):
        self._add("text", raw=f"&#{name};")

    def handle_comment(self, data):
        self._add("other", raw=f"<!--{data}-->")

    def handle_decl(self, decl):
        self._add("other", raw=f"<!{decl}>")


def _is_initial(event: list, letters: str, following: str) -> bool:
    if not letters or len(letters) > 3 or not letters.isalpha() or letters.islower():
        return False
    classes, style = (event[2].get("class") or "").lower(), (event[2].get("style") or "").lower()
    if any(k in classes for k in vocab.DROPCAP_CLASSES) or any(k in style for k in vocab.DROPCAP_STYLES):
        return True
    return len(letters) <= 2 and letters[0].isupper() and following.lstrip()[:1].islower()


def join_initials(html: str) -> str:
    """An element that holds nothing but an initial of 1 to 3 letters becomes text, joined to the text that follows."""
    events = _Tree(html).events
    out, i = [], 0
    while i < len(events):
        e = events[i]
        if e[0] == "start" and e[1] in vocab.DROPCAP_TAGS and i + 3 < len(events):
            inner, end, after = events[i + 1 : i + 4]
            if inner[0] == "text" and end[0] == "end" and end[1] == e[1] and after[0] == "text":
                letters = inner[3].strip()
                if _is_initial(e, letters, after[3]):
                    out.append(letters + after[3])
                    i += 4
                    continue
        out.append(e[3])
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def dropcap_html(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """join_initials over a column, in Arrow batches; null stays null."""
    for html in pages:
        yield html.map(join_initials, na_action="ignore")


# ---- the main content of a page ----------------------------------------------------------------------------------------

_BLOCKS = frozenset("address article blockquote body br center dd div dl dt figcaption h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table td th title tr ul".split())
#: A block of so many words or more is content, if at most this share of its letters is in links.
CONTENT_WORDS, LINK_SHARE = 8, 0.5


class _Visible(HTMLParser):
    """The text outside of hidden elements, however they are nested, in blocks: [texts, letters, letters in links, in a table]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.links = self.tables = 0
        self.blocks: list[list] = [[[], 0, 0, False]]
        self.feed(html)
        self.close()

    def _block(self) -> None:
        if self.blocks[-1][0]:
            self.blocks.append([[], 0, 0, False])

    def handle_starttag(self, tag, attrs):
        if tag in vocab.HIDDEN_ELEMENTS and tag != "input":
            self.hidden.append(tag)
        self.links += tag == "a"
        self.tables += tag == "table"
        if tag in _BLOCKS:
            self._block()

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCKS:
            self._block()

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.links = max(0, self.links - (tag == "a"))
        self.tables = max(0, self.tables - (tag == "table"))
        if tag in _BLOCKS:
            self._block()

    def handle_data(self, data):
        if not self.hidden and data:
            block, letters = self.blocks[-1], sum(map(str.isalnum, data))
            block[0].append(data)
            block[1] += letters
            block[2] += letters * (self.links > 0)
            block[3] = block[3] or self.tables > 0


def visible_text(html: str) -> str:
    """All text outside of hidden elements, pieces of it parted by spaces; entities of all kinds are decoded."""
    return " ".join(t for texts, *_ in _Visible(html).blocks for t in texts)


def main_text(html: str) -> str:
    """The blocks of running text, a line each: those of CONTENT_WORDS or more that are not mostly links and not in tables, and
    short ones without links between two of them. All visible text if there is no such block."""
    blocks = [(" ".join("".join(texts).split()), letters, linked, table) for texts, letters, linked, table in _Visible(html).blocks]
    blocks = [b for b in blocks if b[0]]
    good = [len(text.split()) >= CONTENT_WORDS and linked <= LINK_SHARE * letters and not table for text, letters, linked, table in blocks]
    if not any(good):
        return visible_text(html)
    kept = [g or (0 < i < len(good) - 1 and good[i - 1] and good[i + 1] and not blocks[i][2] and not blocks[i][3]) for i, g in enumerate(good)]
    return "\n".join(b[0] for b, k in zip(blocks, kept, strict=True) if k)


@F.pandas_udf(StringType())
def main_content(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """main_text over a column, in Arrow batches; null has no text."""
    for html in pages:
        yield html.fillna("").map(main_text)


@F.pandas_udf(StringType())
def page_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """visible_text over a column, in Arrow batches; null has no text."""
    for html in pages:
        yield html.fillna("").map(visible_text)
