"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A word is reached through nested classes: its probability is a product of softmaxes, one for each class on its way, over
that class's (at most WIDTH) parts. First comes the word's outer class (the frequent words and the end of a text form one,
the other words are dealt to the rest by their last two bytes), then parts of it by the word's hash, and parts of those.
A class is divided for as long as its words, its most frequent one aside, have at least LEAF_TOKENS training tokens (more
in large corpora, so that divided classes don't outnumber the model's rows): so classes grow with the vocabulary. Words left in one undivided class share it by their counts
plus one, and so does what it gives to unknown words.

Every softmax has hashed features of the words before: the previous one (n-gram) and the one before that (skip), each
with the class to be divided; they tilt a reference, the class's counted division. The weights are trained by gradient:
in each of EPOCHS passes over all training texts, TURNS times, every task sums the gradient of its share of the texts,
the sums meet slab by slab, and the driver, which holds nothing but the model, takes a step. The model has 2^bits rows of
weights a feature, some ROOT_ROWS for the square root of the tokens, at any size of the corpus (it is sent to all tasks:
33 MB of weights for 30 GB of text, 1 GB for 100 TB, for which executors and spark.driver.maxResultSize have to be sized).

Counts of words are exact and cover all training texts. Texts are stored in the shared folder in blocks, without a
shuffle; a block sends its distinct words (as 64-bit keys; of n words some n^2 / 2^61 pairs may be taken for one by
chance) with their counts to the keys' groups once, and is answered with the counts of all texts and the words' classes,
so a frequent word is as many rows as there are blocks, and no vocabulary is broadcast. Each block is then written
again as codes of classes, four bytes a token, by turn; training and scoring read nothing else.

Null texts are empty: one token, their end. Rows without a doc_id are for training (their crc32 is that of the empty
text). Repeated rows count and are scored each for itself. An empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_rows, files_of, in_blocks, met
from .shared import read_table, small, stored, text_bytes
from .substrings import packed, unpacked

FOLDS, HELD_OUT = 7, 2
#: Parts of a class; softmaxes on the way to a word at most.
WIDTH, LEVELS = 16, 7
#: Training tokens in an undivided class, its most frequent word aside, at least; undivided classes for a row of weights, about.
LEAF_TOKENS, ROW_LEAVES = 4096, 8
#: A word is frequent if it is one of so many tokens or more.
FREQUENT_SHARE = 128
#: Bytes of text that count as one token where the classes and tables are laid out.
TOKEN_BYTES = 6
#: Rows of weights a feature for the square root of the tokens; hash bits of a feature's rows, at least.
ROOT_ROWS, MIN_BITS = 2, 12
EPOCHS, TURNS, STEP, PRIOR, DAMPING = 1, 4, 0.8, 8.0, 4.0
#: Bytes of text in a block; behind a group of word keys; groups of a task; bytes of text behind a training task.
BLOCK_BYTES, GROUP_BYTES, TASK_GROUPS, TRAIN_BYTES = 32 << 20, 6 << 20, 8, 64 << 20
#: Rows of weights in a slab; softmaxes computed at once; tokens of a piece.
SLAB, ROWS, PIECE = 4096, 1 << 12, 1 << 15
FAMILIES = 2
END = 0
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CODED = "id long, held boolean, n_tokens long, n_known long, base double, leaf double, codes binary, turn int"
_ONES, _PAIRS = np.ones(WIDTH, np.float32), np.arange(WIDTH // 2)
_START = np.uint64(0xFFFFFFFF)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15], np.uint64)


# ---- words ---------------------------------------------------------------------------------------------------------


def word_keys(words: list[bytes]) -> np.ndarray:
    """A key's top four bits are the word's outer class (1 to 15, by its last two bytes), the others a hash of the word."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    raw, size = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size) - 1
    last = np.where(size > 1, raw[ends] * np.uint64(257) + raw[ends - 1], raw[ends])
    outer = (((last * _MIX[4]) >> np.uint64(40)) % np.uint64(15)) + np.uint64(1)
    return (outer << np.uint64(60)) | (hashes >> np.uint64(4))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the distinct tokens (the end of a text is the last of them; words that differ in case have a key each),
    each token's number in them, each text's number of tokens. texts: binary."""
    # Split and lower-cased as bytes: what isn't ASCII is left as it is, be it UTF-8 or not.
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    before = np.concatenate([[0], np.cumsum(real)])
    numbered = flat.filter(pa.array(real)).dictionary_encode() if len(flat) else pa.array([], pa.large_string()).dictionary_encode()
    keys = word_keys(list(map(bytes.lower, numbered.dictionary.view(pa.large_binary()).to_pylist())))
    n = before[ends[1:]] - before[ends[:-1]] + 1
    index = np.full(int(n.sum()), len(keys), np.int64)
    place = np.ones(len(index), bool)
    place[np.cumsum(n) - 1] = False
    index[place] = numbered.indices.to_numpy()
    return np.append(keys, np.uint64(END)), index, n


# ---- classes -------------------------------------------------------------------------------------------------------


class Shape:
    """Sizes that follow from the bytes of text."""

    def __init__(self, size: int, group_bytes: int = GROUP_BYTES):
        about = max(1, size // TOKEN_BYTES)
        self.groups = max(1, -(-size // group_bytes))
        self.often = max(2, about // FREQUENT_SHARE)
        self.bits = max(MIN_BITS, int(ROOT_ROWS * about**0.5).bit_length())
        self.leaf = max(LEAF_TOKENS, about // (ROW_LEAVES << self.bits))
        #: Classes down to this level are always divided, and a group has whole ones below it.
        self.always = 0
        while 15 * 16**self.always < 8 * self.groups and self.always < LEVELS - 2:
            self.always += 1
        self.always = self.always and self.always + 1

    def group_of(self, keys: np.ndarray) -> np.ndarray:
        prefix = keys >> np.uint64(60 - 4 * max(0, self.always - 1))
        return (((prefix + np.uint64(1)) * _MIX[0]) >> np.uint64(24)) % np.uint64(self.groups)


def node(code: np.ndarray, level: int) -> np.ndarray:
    """The class that is divided at a level, as a number: the code's parts so far and the level."""
    return ((code & np.uint64(0xFFFFFFF)) >> np.uint64(28 - 4 * level) << np.uint64(3)) | np.uint64(level)


def part(code: np.ndarray, level: int) -> np.ndarray:
    return ((code >> np.uint64(24 - 4 * level)) & np.uint64(15)).astype(np.int64)


def node_rows(nodes: np.ndarray, bits: int) -> np.ndarray:
    x = (nodes + np.uint64(1)) * _MIX[0]
    return (((x ^ (x >> np.uint64(31))) * _MIX[4]) >> np.uint64(64 - bits)).astype(np.int64)


def divide(keys: np.ndarray, counts: np.ndarray, shape: Shape, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys of words that aren't frequent: how many softmaxes lead to each, its class's tokens and known words.
    The classes' divisions are added to table."""
    level = np.zeros(len(keys), np.int64)
    tokens_, words = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    some = np.arange(len(keys))
    code = keys >> np.uint64(36)
    np.add.at(table, (node_rows(node(code, 0), shape.bits), part(code, 0)), counts)
    for depth in range(1, LEVELS + 1):
        if not len(some):
            break
        prefix = node(code[some], depth) if depth < LEVELS else code[some]
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        size = np.diff([*starts, len(some)])
        total, most = np.add.reduceat(counts[some], starts), np.maximum.reduceat(counts[some], starts)
        divided = (total - most >= shape.leaf) | (depth < shape.always) if depth < LEVELS else np.zeros(len(starts), bool)
        known = np.add.reduceat((counts[some] > 0).astype(np.int64), starts)
        stay = ~np.repeat(divided, size)
        level[some[stay]] = depth
        tokens_[some[stay]] = np.repeat(total, size)[stay]
        words[some[stay]] = np.repeat(known, size)[stay]
        some = some[~stay]
        if len(some):
            np.add.at(table, (node_rows(node(code[some], depth), shape.bits), part(code[some], depth)), counts[some])
    return level, tokens_, words


def frequent_codes(n: int) -> np.ndarray:
    """Codes of the end of a text and n frequent words: class 0, then as many parts as are needed to tell them apart."""
    digits = 1
    while 16**digits < n + 1:
        digits += 1
    numbers = np.arange(n + 1, dtype=np.uint64)
    return (np.uint64(1 + digits) << np.uint64(28)) | (numbers << np.uint64(24 - 4 * digits))


# ---- the model -----------------------------------------------------------------------------------------------------


class Model:
    """The reference (log shares by class, 2^bits rows) and the weights (as many rows for each family of features)."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits = bits
        table = table.astype(np.float64) + 0.5
        self.reference = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((FAMILIES, 1 << bits, WIDTH), np.float32)

    def events(self, codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Softmaxes of a batch of texts by level: the tokens that have it, their reference rows, feature rows and parts."""
        codes = codes.astype(np.uint64)
        first = np.cumsum(n) - n
        one = np.concatenate([[_START], codes[:-1]])
        one[first] = _START
        two = np.concatenate([[_START], one[:-1]])
        two[first] = _START
        past = (one * _MIX[1], two * _MIX[2])
        levels = codes >> np.uint64(28)
        shift = np.uint64(64 - self.bits)
        for level in range(LEVELS):
            at = np.flatnonzero(levels > np.uint64(level)) if level else np.arange(len(codes))
            if not len(at):
                return
            own = codes[at] if level else codes
            nodes = node(own, level)
            salt = (nodes + np.uint64(1)) * _MIX[0]
            rows = []
            for h in past:
                x = (h[at] if level else h) ^ salt
                x = (x ^ (x >> np.uint64(31))) * _MIX[4]
                rows.append((x >> shift).astype(np.int64))
            yield at, node_rows(nodes, self.bits), rows, part(own, level)

    def shares(self, reference: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What each part has, and the sum by which to divide it."""
        logits = np.take(self.reference, reference, axis=0)
        for w, r in zip(self.weights, rows, strict=True):
            logits += np.take(w, r, axis=0)
        np.exp(logits, out=logits)
        return logits, logits @ _ONES

    def softmax(self, reference: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        p, total = self.shares(reference, rows)
        p /= total[:, None]
        return p

    def gradient(self, codes: np.ndarray, n: np.ndarray, seen: np.ndarray, due: np.ndarray) -> None:
        """Adds what these texts have of each feature and part (seen), and what the model expects (due, of 32 or 64 bits): two
        neighbouring parts at once, as the halves of a complex number, which takes half the additions at scattered places."""
        # As views: arrays made like unpickled ones have a data type object of their own, for which np.add.at has no fast way.
        wide = due.dtype == np.float64
        kind, pair = (np.float64, np.complex128) if wide else (np.float32, np.complex64)
        counts, pairs = [s.reshape(-1).view(np.float32) for s in seen], [d.reshape(-1).view(pair) for d in due]
        for some, lengths in _pieces(codes, n):
            for _, reference, rows, y in self.events(some, lengths):
                for a in range(0, len(y), ROWS):
                    p, z = self.softmax(reference[a : a + ROWS], [r[a : a + ROWS] for r in rows]).astype(kind), y[a : a + ROWS]
                    for f, r in enumerate(x[a : a + ROWS] for x in rows):
                        np.add.at(counts[f], r * WIDTH + z, np.float32(1))
                        np.add.at(pairs[f], (r[:, None] * (WIDTH // 2) + _PAIRS).ravel(), p.view(pair).ravel())

    def step(self, gradient: np.ndarray, mass: np.ndarray) -> None:
        """Each weight by its gradient (seen - due, less a turn's share of a Gaussian prior) over the larger of the two and a
        constant. mass: seen + due."""
        pull = gradient - PRIOR / TURNS * self.weights
        self.weights += (STEP * pull / ((mass + np.abs(gradient)) / 2 + DAMPING)).astype(np.float32)

    def log10(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the product of each token's softmaxes."""
        out, first = np.zeros(len(codes)), 0
        for some, lengths in _pieces(codes, n):
            own = out[first : first + len(some)]
            first += len(some)
            for at, reference, rows, y in self.events(some, lengths):
                for a in range(0, len(y), ROWS):
                    p, total = self.shares(reference[a : a + ROWS], [r[a : a + ROWS] for r in rows])
                    own[at[a : a + ROWS]] += np.log10(np.maximum(p[np.arange(len(p)), y[a : a + ROWS]] / total, 1e-30))
        return out


def _pieces(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts of some PIECE tokens (or one that is longer): what is made of them stays in a processor's cache."""
    ends = np.cumsum(n)
    a = first = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        yield codes[first : ends[b - 1]], n[a:b]
        a, first = b, int(ends[b - 1])


def _halved(x: np.ndarray) -> bytes:
    """float32 values, the upper half of their bits, rounded."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32).ravel() + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2").tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)


# ---- counting ------------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _sender(shape: Shape):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, counts = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            group = shape.group_of(keys)
            order = np.argsort(group, kind="stable")
            keys, counts, group = keys[order], counts[order], group[order]
            which, starts = np.unique(group, return_index=True)
            cuts = [*starts.tolist(), len(keys)]
            raw = [(packed(keys[a:b]), _planes(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array([block] * len(raw), pa.int64()), pa.array([x for x, _ in raw], pa.binary()), pa.array([x for _, x in raw], pa.binary())], ["grp", "block", "words", "counts"])

        now, parts = None, []
        for batch in small(batches):
            block, held = batch.column("block").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now is not None and block[a] != now:
                    yield told(now, parts)
                    parts = []
                now = int(block[a])
                keys, index, n = tokens(batch.column("text").slice(a, b - a))
                parts.append((keys, np.bincount(index, np.repeat(~held[a:b], n), len(keys)).astype(np.int64)))
                if len(parts) == 8:
                    parts = [_counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        if now is not None:
            yield told(now, parts)

    return send


_ADDED = "block long, words binary, counts binary, levels binary, leaf_tokens binary, leaf_words binary, often array<long>, often_counts array<long>, sums array<long>, slab int, division binary"


def _adder(shape: Shape):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "counts", "levels", "leaf_tokens", "leaf_words")), ("often", longs), ("often_counts", longs), ("sums", longs), ("slab", pa.int32()), ("division", pa.binary())])
    nothing = dict.fromkeys(schema.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group. Answers each block with all texts' counts and the words' classes, and says what the groups hold."""
        table = np.zeros((1 << shape.bits, WIDTH))

        def answers(rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            parts = [unpacked(w) for _, w, _ in rows]
            keys, counts = _counted(np.concatenate(parts), np.concatenate([_unplaned(c) for _, _, c in rows]))
            often = (keys == np.uint64(END)) | (counts >= shape.often)
            levels, leaf_tokens, leaf_words = (np.zeros(len(keys), np.int64) for _ in range(3))
            levels[~often], leaf_tokens[~often], leaf_words[~often] = divide(keys[~often], counts[~often], shape, table)
            told = [nothing | {"often": keys[often].view(np.int64), "often_counts": counts[often], "sums": [int(counts.sum()), int((counts > 0).sum())]}]
            for (block, words, _), own in zip(rows, parts, strict=True):
                at = np.searchsorted(keys, own)
                told.append(nothing | {"block": block, "words": words, "counts": _planes(counts[at]), "levels": levels[at].astype(np.uint8).tobytes(), "leaf_tokens": _planes(leaf_tokens[at]), "leaf_words": _planes(leaf_words[at])})
            yield pa.RecordBatch.from_pylist(told, schema=schema)

        group, rows = None, []
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "words", "counts")), strict=True):
                if own != group and rows:
                    yield from answers(rows)
                    rows = []
                group = own
                rows.append(tuple(row))
        if rows:
            yield from answers(rows)
            slabs = range(0, len(table), SLAB)
            yield pa.RecordBatch.from_pylist([nothing | {"slab": s // SLAB, "division": table[s : s + SLAB].astype("<f8").tobytes()} for s in slabs if table[s : s + SLAB].any()], schema=schema)

    return add


def _added_slabs(columns: list[str], kinds: list):
    """Sums of the columns by slab; kinds: how each is read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for slab, *raw in zip(*(batch.column(c).to_pylist() for c in ("slab", *columns)), strict=True):
                new = [kind(x).astype(np.float64) for kind, x in zip(kinds, raw, strict=True)]
                sums[slab] = [a + b for a, b in zip(sums[slab], new, strict=True)] if slab in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i].astype(np.float32).tobytes() for s in sums.values()], pa.binary()) for i in range(len(columns)))], ["slab", *columns])

    return add


def _summed(slabs: DataFrame, columns: list[str], kinds: list, rows: int) -> list[np.ndarray]:
    """Tables of so many rows from their slabs: a few times the size of the model, on the driver."""
    schema = "slab int, " + ", ".join(f"{c} binary" for c in columns)
    found = slabs.repartition(-(-rows // SLAB), "slab").mapInArrow(_added_slabs(columns, kinds), schema).collect()
    out = [np.zeros((rows, WIDTH), np.float32) for _ in columns]
    for r in found:
        for table, c in zip(out, columns, strict=True):
            piece = np.frombuffer(r[c], np.float32).reshape(-1, WIDTH)
            table[r.slab * SLAB : r.slab * SLAB + len(piece)] = piece
    return out


# ---- coding, training, scoring -------------------------------------------------------------------------------------


def _coder(often: np.ndarray, tokens_: int, words: int):
    """often: keys of the end and the frequent words, in the order of their codes."""
    codes_of_often = frequent_codes(len(often) - 1)
    by_key = np.argsort(often)

    def classes(answers: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of a block's words, their counts, codes and log10 of their share of their class."""
        if not answers:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0)
        keys = np.concatenate([unpacked(a[0]) for a in answers])
        counts, leaf_tokens, leaf_words = (np.concatenate([_unplaned(a[i]) for a in answers]) for i in (1, 3, 4))
        levels = np.concatenate([np.frombuffer(a[2], np.uint8) for a in answers]).astype(np.uint64)
        cut = np.uint64(28) - np.uint64(4) * levels
        codes = (levels << np.uint64(28)) | (keys >> np.uint64(36) >> cut << cut)
        share = np.log10((counts + 1.0) / (leaf_tokens + leaf_words + 1.0))
        own = np.flatnonzero(levels == 0)  # frequent, or the end
        codes[own], share[own] = codes_of_often[by_key[np.searchsorted(often[by_key], keys[own])]], 0.0
        order = np.argsort(keys)
        return keys[order], counts[order], codes[order].astype(np.uint32), share[order]

    def coded(batch: pa.RecordBatch, known: tuple, first: int) -> pa.RecordBatch:
        keys, index, n = tokens(batch.column("text"))
        at = np.searchsorted(known[0], keys)
        if (known[0][at] != keys).any():
            raise RuntimeError("a word of a block has no count")
        counts, codes, share = (x[at] for x in known[1:])
        start = np.cumsum(n) - n
        summed = lambda x: np.add.reduceat(x[index], start)  # noqa: E731  every text has a token
        raw, edges = codes[index].astype("<u4").tobytes(), (np.concatenate([start, [n.sum()]]) * 4).tolist()
        base = np.log10((counts + 1.0) / (tokens_ + words + 1.0))
        turn = (first + np.arange(len(n))) % TURNS
        turn[batch.column("held").to_numpy(zero_copy_only=False)] = TURNS
        columns = [batch.column("id"), batch.column("held"), pa.array(n, pa.int64()), pa.array(summed((counts > 0).astype(np.int64))), pa.array(summed(base)), pa.array(summed(share)), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array(turn, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _CODED.split(", ")])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, answers in block_rows(batches, ("words", "counts", "levels", "leaf_tokens", "leaf_words")):
            known, first = classes(answers), 0
            for batch in small(files.batches(["id", "held", "text"])):
                if len(batch):
                    yield coded(batch, known, first)
                first += len(batch)

    return code


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("codes").to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def _trainer(sent):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen, due = np.zeros(model.weights.shape, np.float32), np.zeros(model.weights.shape)
        for batch in small(batches, 2 << 20):
            if len(batch):
                model.gradient(*_codes(batch), seen, due)
        gradient, mass = ((x.reshape(-1, WIDTH)) for x in (seen - due, seen + due))
        at = [s for s in range(0, len(mass), SLAB) if mass[s : s + SLAB].any()]
        yield pa.RecordBatch.from_arrays([pa.array([s // SLAB for s in at], pa.int32()), *(pa.array([_halved(x[s : s + SLAB]) for s in at], pa.binary()) for x in (gradient, mass))], ["slab", "gradient", "mass"])

    return train


def _scorer(sent, tokens_: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2 << 20):
            if len(batch):
                codes, n = _codes(batch)
                own = np.add.reduceat(sent.value.log10(codes, n), np.cumsum(n) - n)
                columns = [*(batch.column(c) for c in ("id", "held", "n_tokens", "n_known")), pa.array(np.full(len(n), tokens_, np.int64)), batch.column("base"), pa.array(own + batch.column("leaf").to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return score


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def coded_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, Model, int, int]:
    """Every row of docs as _CODED, the untrained model, the training texts' tokens, and the bytes of all texts."""
    number = F.col(id_col).cast("long")
    held = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(number.alias("id"), held.alias("held"), text_bytes(text_col).alias("text"))
    blocks = in_blocks(rows, "text", block_bytes, "lm-blocks")
    files = files_of(blocks)
    size = blocks.agg(F.sum(F.length("text")).alias("n"), F.count_distinct("block").alias("blocks")).first()
    shape = Shape(size.n or 0, group_bytes)
    sent = blocks.select("block", "held", "text").mapInArrow(_sender(shape), "grp long, block long, words binary, counts binary")
    added = stored(sent.repartition(-(-shape.groups // TASK_GROUPS), "grp").sortWithinPartitions("grp").mapInArrow(_adder(shape), _ADDED), "lm-counts")
    whole = added.filter("often IS NOT NULL")
    found = whole.select(F.explode(F.arrays_zip("often", "often_counts")).alias("w")).select("w.often", "w.often_counts").collect()  # some hundreds
    ends = sum(r.often_counts for r in found if r.often == END)
    often = sorted(((r.often_counts, r.often % (1 << 64)) for r in found if r.often != END), reverse=True)
    sums = whole.agg(F.sum(F.col("sums")[0]).alias("tokens"), F.sum(F.col("sums")[1]).alias("words")).first()
    (table,) = _summed(added.filter("slab IS NOT NULL").select("slab", "division"), ["division"], [lambda raw: np.frombuffer(raw, "<f8")], 1 << shape.bits)
    codes = frequent_codes(len(often))
    for level in range(int(codes[0] >> np.uint64(28))):
        np.add.at(table, (node_rows(node(codes, level), shape.bits), part(codes, level)), np.array([ends, *(c for c, _ in often)], np.float32))
    keys = np.array([END, *(k for _, k in often)], np.uint64)
    answers = added.filter("block IS NOT NULL").select("block", "words", "counts", "levels", "leaf_tokens", "leaf_words")
    coded = stored(met(files, answers, size.blocks).mapInArrow(_coder(keys, sums.tokens or 0, sums.words or 0), _CODED), "lm-codes", by="turn")
    return coded, Model(shape.bits, table), sums.tokens or 0, size.n or 0


def train(coded: DataFrame, model: Model, size: int, epochs: int = EPOCHS) -> None:
    """Takes the model's steps: epochs * TURNS of them, each on the gradient of one turn's texts."""
    context = coded.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, size // (TURNS * TRAIN_BYTES))
    for turn in [t for _ in range(epochs) for t in range(TURNS)]:
        sent = context.broadcast(model)
        sums = coded.filter(F.col("turn") == turn).select("codes").coalesce(tasks).mapInArrow(_trainer(sent), "slab int, gradient binary, mass binary")
        gradient, mass = _summed(sums, ["gradient", "mass"], [_whole, _whole], FAMILIES << model.bits)
        model.step(gradient.reshape(model.weights.shape), mass.reshape(model.weights.shape))
        sent.unpersist()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """SCHEMA, for every row of docs."""
    coded, model, tokens_, size = coded_texts(docs, id_col, text_col, block_bytes, group_bytes)
    if tokens_:
        train(coded, model, size, epochs)
    return coded.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), tokens_), SCHEMA)


def op9_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
