"""Personal data by fixed rules and a semi-Markov conditional random field.

The rules find e-mail addresses, IPv4 addresses, card and telephone numbers; what they find always stays. The model adds
spans that rules of a fixed form miss (national telephone and identity numbers, masked e-mail addresses): segments of at
most MAX_TOKENS tokens are scored as wholes by features of the entire span (its shape, digits, check digit, what stands
before and around it), and a dynamic programme over segment ends picks boundaries and types together. A segment that
holds neither a digit nor a mark of an address has no feature and can't be an entity, so only the words that hold one,
and their neighbours that do, are decoded; elsewhere the best segmentation is known: all outside. A span of the model
that meets a span of the rules gives way.

The model is trained here, by the exact gradient of its likelihood, on TRAINING synthetic lines made from a fixed seed.

Null and empty texts have no span. Texts are processed whole, each row for itself; null ids stay null; repeated rows
give repeated results; an empty table gives an empty result; other columns play no part. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, small

KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 14
MAX_CHARS = 80
#: Synthetic lines that the model is fitted to, and passes over them.
TRAINING, EPOCHS = 240, 25
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive, and from the start of a run of digits only: the same matches without trying every digit of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = {ord(c): None for c in " ().+-"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].translate(_DIGITS)
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_DIGITS)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the model's view of a text -----------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")
_MASKS = ("[at]", "(at)")
_DIGIT, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
_WHITE = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_SHAPES = {
    "address": r"\S+@a+(?:\.a+)+",
    "masked": r"[a9._-]+ ?[\[(]a[\])] ?[a9-]+(?: ?(?:\.|[\[(]a[\])]) ?a)+",
    "dotted4": r"9{1,3}(?:\.9{1,3}){3}",
    "grouped16": r"9{4}(?:[ -]9{4}){3}",
    "national": r"\(9{2,4}\)[ -]?9{3,4}[ .-]?9{3,4}|9{3}[-.]9{3}[-.]9{4}|9{4}-9{4}-9{3,4}",
    "plus": r"\+9[9 ().-]+9",
    "identity": r"9{3}-9{2}-9{4}",
    "date": r"9{1,4}[-/.]9{1,2}[-/.]9{1,4}",
    "clock": r"9{1,2}[:.]9{2}(?::9{2})?",
    "decimal": r"9{1,3}(?:[.,]9{3})*(?:[.,]9+)?",
    "integer": r"9+",
    "range": r"9+[-/:]9+",
}
_PATTERNS = {name: re.compile(p) for name, p in _SHAPES.items()}
_CUES = {
    "phone": frozenset("tel telp telephone telepon phone call fax mobile whatsapp hotline hubungi".split()),
    "card": frozenset("card visa mastercard credit debit kartu".split()),
    "id": frozenset("ssn social security passport nik ktp identity".split()),
    "email": frozenset("email mail contact write".split()),
    "ip": frozenset("ip host server address".split()),
}
_BUCKETS = (5, 7, 8, 10, 11, 12, 14, 16, 17, 20)
FEATURES = ("bias", *_SHAPES, *(f"digits<{b}" for b in (*_BUCKETS, "inf")), "check", "octets", "letters", "loose", "money", *(f"cue_{k}" for k in _CUES))
_AT = {name: i for i, name in enumerate(FEATURES)}


@lru_cache(maxsize=20_000)
def _shape_features(shape: str) -> tuple[int, ...]:
    found = [_AT["bias"], *(_AT[name] for name, p in _PATTERNS.items() if p.fullmatch(shape))]
    digits = shape.count("9")
    found.append(_AT["digits<inf"] - len(_BUCKETS) + bisect_right(_BUCKETS, digits))
    if "a" in shape:
        found.append(_AT["letters"])
    if len(found) == 2 + ("a" in shape):
        found.append(_AT["loose"])  # of no known form
    return tuple(found)


class Run:
    """Words with a trigger, and their tokens."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        words = [w.strip(".,:;()").lower() for w in text[max(0, start - 40) : start].split()[-3:]]
        self.context = [_AT[f"cue_{k}"] for k, cues in _CUES.items() if any(w in cues for w in words)]

    def candidates(self) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """Segments that may be entities (first token, last token + 1, features), by their first token."""
        text, tokens, n = self.text, self.tokens, len(self.tokens)
        for i, (a, _) in enumerate(tokens):
            if (a and text[a - 1].isalnum()) or not (text[a].isalnum() or text[a] in "+("):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                b = tokens[j - 1][1]
                if b - a > MAX_CHARS:
                    break
                if not (text[b - 1].isalnum() or text[b - 1] in ")]") or (b < len(text) and text[b].isalnum()):
                    continue
                span = text[a:b]
                if not _TRIGGER.search(span):
                    continue
                shape = _LETTERS.sub("a", _DIGIT.sub("9", span))
                features = [*_shape_features(shape), *self.context]
                digits = span.translate(_DIGITS)
                if 14 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and luhn(digits):
                    features.append(_AT["check"])
                if _AT["dotted4"] in features and all(int(p) <= 255 for p in span.split(".")):
                    features.append(_AT["octets"])
                if text[max(0, a - 3) : a].rstrip()[-1:] in ("$", "€", "£") and a:
                    features.append(_AT["money"])
                yield i, j, tuple(features)

    @cached_property
    def segments(self) -> list[tuple[int, int, tuple[int, ...]]]:
        return list(self.candidates())

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """A row per segment, a column per kind."""
        return np.array([weights[:, f].sum(axis=1) for _, _, f in map(lambda s: (s[0], s[1], list(s[2])), self.segments)]).reshape(-1, len(KINDS))


def runs(text: str) -> Iterator[Run]:
    """Words with a trigger, joined where single spaces part them."""
    end = 0
    found = _TRIGGER.search(text)
    while found:
        at = found.start()
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        if text.startswith(_MASKS, start) and start - 1 > end and text[start - 1] == " ":
            start -= 1  # a mask that stands alone: with the word before it
            while start > end and not text[start - 1].isspace():
                start -= 1
        while True:
            stop = _WHITE.search(text, at)
            stop = stop.start() if stop else len(text)
            after = _WHITE.search(text, stop + 1) if text[stop : stop + 1] == " " else None
            following = (after.start() if after else len(text)) if text[stop : stop + 1] == " " else stop
            if following <= stop + 1:
                break
            more = _TRIGGER.search(text, stop + 1, following)
            if not more and not text.startswith(_MASKS, at):
                break
            at = more.start() if more else stop + 1
        yield Run(text, start, stop)
        end = stop
        found = _TRIGGER.search(text, stop)


class Scores:
    """The best kind of a segment and its score (outside scores 0), remembered by its features."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def best(self, features: tuple[int, ...]) -> tuple[int, float]:
        found = self.known.get(features)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            row = self.weights[:, list(features)].sum(axis=1)
            kind = int(row.argmax())
            found = self.known[features] = kind, float(row[kind])
        return found


def decode(run: Run, scores: Scores) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation's entities. Segments are looked at once, by their start, and not kept;
    of two equal segmentations the one whose last entity ends first, then starts first, is taken."""
    n = len(run.tokens)
    best, back = array("d", bytes(8 * (n + 1))), {}
    now = 0
    for i, j, features in run.candidates():
        kind, score = scores.best(features)
        if score <= 0:
            continue
        while now < i:  # what ends at a token is known once its segments are behind
            now += 1
            if best[now - 1] >= best[now]:
                best[now] = best[now - 1]
                back.pop(now, None)
        if best[i] + score > best[j]:
            best[j] = best[i] + score
            back[j] = i, kind
    while now < n:
        now += 1
        if best[now - 1] >= best[now]:
            best[now] = best[now - 1]
            back.pop(now, None)
    out, j = [], n
    while j:
        if j in back:
            i, kind = back[j]
            out.append((run.tokens[i][0], kind, run.tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def gradient(run: Run, gold: set[tuple[int, int, int]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold entities (first token, last + 1, kind) and its gradient, by sums over segmentations."""
    n, scores = len(run.tokens), run.scores(weights)
    fore, aft = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fore[0] = aft[n] = 0.0
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(run.segments):
        ending[j].append(s)
        starting[i].append(s)
    total = np.logaddexp.reduce(scores, axis=1) if len(scores) else scores.sum(axis=1)
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[run.segments[s][0]] + total[s] for s in ending[j])])
    for i in range(n - 1, -1, -1):
        aft[i] = np.logaddexp.reduce([aft[i + 1], *(aft[run.segments[s][1]] + total[s] for s in starting[i])])
    out, likelihood = np.zeros_like(weights), -fore[n]
    for s, (i, j, features) in enumerate(run.segments):
        p = np.exp(fore[i] + scores[s] + aft[j] - fore[n])
        for k in range(len(KINDS)):
            if (i, j, k) in gold:
                likelihood += scores[s][k]
                p[k] -= 1.0
        out[:, list(features)] -= p[:, None]
    return float(likelihood), out


def synthetic(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with (start, kind, end) of their entities; half of them have none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = digits(15)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return d if r.random() < 0.5 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        body = digits(15)
        return body + next(c for c in "0123456789" if not luhn(body + c))

    entities = [
        (0, lambda: f"{word()}.{digits(2)}@{word()}.com", "mail"),
        (0, lambda: f"{word()}[at]{word()}.org", "mail"),
        (0, lambda: f"{word()} (at) {word()}.{word()}", "contact"),
        (1, lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "server"),
        (2, card, "card"),
        (3, lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", "call"),
        (3, lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(7)}", "phone"),
        (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "tel"),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", "phone"),
        (4, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ssn"),
    ]
    others = [
        lambda: digits(4), lambda: f"{r.randint(1, 9)}.", lambda: f"{r.randint(1, 99)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{digits(4)}",
        lambda: f"${digits(3)},{digits(3)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}={digits(2)}{word()}{digits(5)}a{digits(3)}", lambda: digits(r.randint(5, 20)), no_card, no_card, lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"({digits(1)})", lambda: " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(2, 8))), lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{300 + int(digits(2))}.{digits(3)}.{digits(3)}.{digits(3)}",
        lambda: f"{digits(4)}-{digits(4)}", lambda: "-".join(digits(5) for _ in range(3)), lambda: f"{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
    ]
    out = []
    for i in range(n):
        line = " ".join(word() for _ in range(r.randint(0, 4)))
        if i % 2:
            kind, make, cue = entities[i // 2 % len(entities)]
            line += f" {cue} " if r.random() < 0.6 else " "
            made = make()
            spans = [(len(line), kind, len(line) + len(made))]
        else:
            line, made, spans = f"{line} ", r.choice(others)(), []
        out.append((line + made + r.choice(["", ".", ", ", " "]) + word().rjust(r.choice([0, 12])), spans))
    # a word glued to an entity would change it
    return [(t, s) for t, s in out if all(not t[e : e + 1].isalnum() for _, _, e in s)]


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """The weights, a row per kind; the same on every machine."""
    cases = []
    for text, spans in synthetic(TRAINING):
        for run in runs(text):
            first = {a: i for i, (a, _) in enumerate(run.tokens)}
            last = {b: i + 1 for i, (_, b) in enumerate(run.tokens)}
            cases.append((run, {(first[a], last[b], k) for a, k, b in spans if a in first and b in last}))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -3.0
    seen = np.full_like(weights, 1e-6)
    order = random.Random(11)
    for _ in range(EPOCHS):
        order.shuffle(cases)
        for run, gold in cases:
            g = gradient(run, gold, weights)[1] - 2e-4 * weights
            seen += g * g
            weights += 0.4 * g / np.sqrt(seen)
    return weights


def spans_of(text: str, scores: Scores) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What the rules find, and all spans: both (start, kind, end), sorted."""
    base = base_spans(text)
    if not base and not _TRIGGER.search(text):
        return base, base
    more = [s for run in runs(text) for s in decode(run, scores)]
    if not more:
        return base, base
    if not base:
        return base, sorted(more)
    starts, ends = [s[0] for s in base], np.maximum.accumulate([s[2] for s in base]).tolist()
    free = []
    for a, k, b in more:
        before = bisect_left(starts, b)  # those that start before b; the last end of them tells
        if before == 0 or ends[before - 1] <= a:
            free.append((a, k, b))
    return base, sorted(base + free)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _finder(weights: np.ndarray):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(weights)
        for batch in small(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = spans_of(text, scores)
                n = [0] * len(BASE_KINDS)
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return find


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: counts of the rules' spans, their digest, and all spans as kind:start:end."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(_finder(trained()), SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are one, of the first one's kind."""
    out, end = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def _redactor(weights: np.ndarray, column: str, count: str | None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(weights)
        for batch in small(batches):
            texts = [t if t is None else redact(t, spans_of(t, scores)[1]) for t in batch.column(column).to_pylist()]
            names = batch.schema.names
            batch = batch.set_column(names.index(column), column, pa.array(texts, batch.schema.field(column).type))
            if count:
                lengths = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
                batch = batch.set_column(names.index(count), count, lengths)
            yield batch

    return apply


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the spans of text_col replaced, all other columns kept; count_col, if named, gets the new length."""
    return docs.mapInArrow(_redactor(trained(), text_col, count_col), docs.schema)


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
