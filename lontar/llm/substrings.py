"""Substring deduplication by prefix-partitioned suffix trees over words.

Every place where WINDOW words follow starts a suffix. Only suffixes that share their first WINDOW words with another one
can lie below a deep internal node, so fingerprints come first: a block of texts sends each of its distinct windows once,
as a fingerprint cut to the bits that the size of the corpus needs, to the task of its range of fingerprints, and is told
which of them some other block has too (all true ones, and a few others: one in 2^SPARE or so).

The suffixes that are left are split by their prefixes of WINDOW words into groups that fit a task's memory. Prefixes go
together if the same word has the least hash of those that aren't common (in corpora of very many groups, the same two
words and so on), so that suffixes that begin near each other mostly do; a group that is still too large is split by
whole windows. Suffixes are sent with their words, those that overlap in the text as one passage. In a group the
suffixes of all blocks are sorted by their words, and the words that neighbours share from the start (LCP) give the tree:
an internal node of depth WINDOW or more is a run of neighbours that share as many. As only repeats of WINDOW words
count, trees are cut at that depth. Of each node, the blocks are told the smallest doc_id. Within a block the same tree
is built over the block's own suffixes, so a block sends one suffix for each of its nodes. No fingerprint decides that
words are equal. The removed words of a document are the union of the repeats that it has from a smaller doc_id; runs of
them are its maximal repeated passages.

Null texts and texts without words have nothing to remove; rows with one doc_id don't repeat each other; rows without a
doc_id take no part and are returned whole; an empty table gives an empty result; other columns play no part, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, Files, block_rows, files_of, in_blocks, met
from .shared import read_table, small, stored

WINDOW = 13
#: Bytes of text behind a range of fingerprints; suffixes of a group, of a part of a group whose tree is built at once, of a
#: part of a block that is sorted at once, of a message.
RANGE_BYTES, GROUP_SUFFIXES, TREE_SUFFIXES, SORTED_AT_ONCE, SENT_AT_ONCE = 16 << 20, 1 << 19, 1 << 20, 1 << 19, 1 << 18
#: zstd's level for what is shuffled.
LEVEL = 6
#: Bytes of messages that a sender holds.
HELD_BYTES = 8 << 20
#: Letters that a sorted word can leave out because the word before it begins with them, at most.
SHARED = 12
#: Bits of a fingerprint beyond those that number the windows: one in 2^SPARE is told to be repeated by chance, at most.
SPARE = 6
#: A word is common if it is one of so many words of a block or more; a block names at most as many.
COMMON_SHARE = 1 << 18
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string"
_MESSAGE = "grp long, block long, words binary, n_words int, ids binary, steps binary, at binary, owner binary, removed binary, extra binary, like binary"


def _constants(n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Odd multipliers, by the splitmix64 generator."""
    out, x, mask = [], seed, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


_MIX = _constants(WINDOW)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte plane: the high planes are zeros, which compress."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes | None) -> np.ndarray:
    planes = np.frombuffer(raw or b"", np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _compressed(raw: bytes) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _pressed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as packed, compressed, behind their number."""
    return len(values).to_bytes(8, "little") + _compressed(packed(values))


def _expanded(raw: bytes) -> np.ndarray:
    return unpacked(pa.decompress(raw[8:], 8 * int.from_bytes(raw[:8], "little"), "zstd", asbytes=True))


def _squeezed(values: np.ndarray) -> bytes:
    """64-bit values in any order, as compressed byte planes of their differences (modulo 2^64)."""
    steps = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    return _compressed(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueezed(raw: bytes, n: int) -> np.ndarray:
    return unpacked(pa.decompress(raw, 8 * n, "zstd", asbytes=True)).view(np.int64) if n else np.empty(0, np.int64)


def _fronted(words: pa.Array) -> bytes:
    """Sorted words (of 64-bit offsets), each without the letters that it shares with the one before, compressed: byte planes
    of what is left of their lengths, numbers of shared letters, letters; behind its size."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, n = ends[:-1] - ends[0], np.diff(ends)
    shared, alike = np.zeros(len(words), np.int64), np.arange(1, len(words))
    for j in range(SHARED):
        alike = alike[np.minimum(n[alike], n[alike - 1]) > j]
        alike = alike[letters[starts[alike] + j] == letters[starts[alike - 1] + j]]
        shared[alike] += 1
    own = _own_letters(starts, shared, len(letters))
    raw = b"".join(((n - shared).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), shared.astype(np.uint8).tobytes(), letters[own].tobytes()))
    return len(raw).to_bytes(8, "little") + _compressed(raw)


def _unfronted(raw: bytes, n_words: int) -> pa.LargeBinaryArray:
    raw = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), np.uint8)
    shared = raw[4 * n_words : 5 * n_words].astype(np.int64)
    n = np.ascontiguousarray(raw[: 4 * n_words].reshape(4, -1).T).view("<u4").ravel() + shared
    ends = np.concatenate([[0], np.cumsum(n)])
    starts, letters = ends[:-1], np.empty(ends[-1], np.uint8)
    letters[_own_letters(starts, shared, len(letters))] = raw[5 * n_words :]
    for j in range(int(shared.max(initial=0))):
        # It is a letter of the last word before that has one of its own at this place.
        some = np.flatnonzero(shared > j)
        source = np.maximum.accumulate(np.where(shared > j, 0, np.arange(n_words)))[some]
        letters[starts[some] + j] = letters[starts[source] + j]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters)])


def _own_letters(starts: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    own = np.ones(n, bool)
    for j in range(int(shared.max(initial=0))):
        own[starts[shared > j] + j] = False
    return own


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted. Of millions of numbers, a sort is much faster than numpy's unique, which hashes them."""
    ordered = np.sort(values)
    return ordered[_starts(ordered)]


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (rows of word numbers) by their words, and how many words each shares with the one before it:
    the internal nodes of their tree are the runs of neighbours that share a number of words."""
    if not len(suffixes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(1, int(suffixes.max()).bit_length())
    each = 64 // bits
    keys = []
    for a in range(0, suffixes.shape[1], each):
        key = np.zeros(len(suffixes), np.uint64)
        for j in range(a, min(a + each, suffixes.shape[1])):
            key = (key << np.uint64(bits)) | suffixes[:, j].astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    shared, alike = np.zeros(len(order), np.int64), np.ones(len(order) - 1, bool)
    for j in range(suffixes.shape[1]):
        column = suffixes[order, j]
        alike &= column[1:] == column[:-1]
        shared[1:] += alike
    return order, shared


class Block:
    """The words of some texts, numbered, with each window's fingerprint. Windows of rows without an id don't count."""

    def __init__(self, texts: Iterator[tuple[pa.Array, pa.Array]]):
        ids, lists, lengths = [], [], []
        for own, text in texts:
            split = pc.ascii_split_whitespace(text.cast(pa.large_binary()).view(pa.large_string()))
            flat = split.flatten()
            real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
            before = np.concatenate([[0], np.cumsum(real)])
            at = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
            ids.append(own)
            lists.append(flat.filter(pa.array(real)))
            lengths.append(np.diff(at))
        numbered = (pa.chunked_array(lists) if lists else pa.chunked_array([], pa.large_string())).combine_chunks().dictionary_encode()
        numbered = numbered.chunk(0) if isinstance(numbered, pa.ChunkedArray) else numbered
        self.words, self.number = numbered.dictionary, numbered.indices.to_numpy().astype(np.int32)
        n = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        owner = pa.chunked_array(ids, pa.int64()) if ids else pa.chunked_array([], pa.int64())
        left = np.repeat(np.cumsum(n), n) - np.arange(len(self.number))  # words from here to the text's end
        self.has_id = np.repeat(~owner.is_null().to_numpy().astype(bool), n)
        self.at = np.flatnonzero((left >= WINDOW) & self.has_id)  # where windows start
        self.owner = np.repeat(owner.fill_null(0).to_numpy(), n)[self.at]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter(map(digest, self.words.view(pa.large_binary()).to_pylist()), np.uint64, len(self.words))

    def sort_words(self) -> None:
        """Numbers the words in their order."""
        order = pc.sort_indices(self.words.view(pa.large_binary())).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.number, self.hashes = self.words.take(pa.array(order)), place[self.number], self.hashes[order]

    def prints(self) -> np.ndarray:
        hashed, out = self.hashes[self.number], np.zeros(len(self.at), np.uint64)
        for j in range(WINDOW):
            out += hashed[self.at + j] * _MIX[j]
        return out ^ (out >> np.uint64(32)) * _MIX[0]

    def suffixes(self, windows: np.ndarray) -> np.ndarray:
        """The words of some windows (indices of at), a row for each."""
        at = self.at[windows]
        return np.stack([self.number[at + j] for j in range(WINDOW)], axis=1) if len(at) else np.empty((0, WINDOW), np.int32)

    def nodes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows that the block has more than once: their indices, node by node, and where nodes start."""
        order = np.argsort(prints)
        ordered = prints[order]
        starts = _starts(ordered)
        n = np.diff([*starts, len(ordered)])
        many, sizes = order[np.repeat(n > 1, n)], n[n > 1]
        ends = np.cumsum(sizes)
        windows, edges, done = [], [], 0
        a = 0
        while a < len(sizes):  # parts of the block's tree: equal windows have equal fingerprints
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SORTED_AT_ONCE, "right")))
            some = many[ends[a - 1] if a else 0 : ends[b - 1]]
            suffixes = self.suffixes(some)
            # Neighbours of the same words are one leaf; the tree is built over the leaves.
            leaf = np.concatenate([[0], np.flatnonzero((suffixes[1:] != suffixes[:-1]).any(axis=1)) + 1])
            size = np.diff([*leaf, len(some)])
            place, shared = subtree(suffixes[leaf])
            size, first = size[place], leaf[place]
            to = np.cumsum(size)
            windows.append(some[np.repeat(first - to + size, size) + np.arange(len(some))])
            edges.append(done + (to - size)[shared < WINDOW])
            done, a = done + len(some), b
        if not windows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(windows), np.concatenate(edges)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    return ((b.column("id"), b.column("text")) for b in batches)


def _runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    now, held = None, []
    for batch in batches:
        number = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and number[a] != now:
                yield now, held
                held = []
            now = int(number[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


# ---- which windows several blocks have -----------------------------------------------------------------------------


def _printer(bits: int, ranges: int):
    """Each block's fingerprints and the hashes of its common words, both by range: a row for a block and a range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _runs_of_blocks(batches):
            block = Block(_texts(iter(held)))
            prints = _distinct(block.prints() >> np.uint64(64 - bits))
            cuts = np.searchsorted(prints, [(i << bits) // ranges for i in range(ranges + 1)])
            n = np.bincount(block.number, minlength=len(block.words))
            common = _distinct(block.hashes[n * COMMON_SHARE >= max(1, len(block.number))])
            word_cuts = np.searchsorted(common >> np.uint64(1), [(i << 63) // ranges for i in range(ranges + 1)])
            cuts, word_cuts = cuts.tolist(), word_cuts.tolist()
            rows = [{"grp": i, "block": number, "prints": _pressed(prints[cuts[i] : cuts[i + 1]]), "common": _pressed(common[word_cuts[i] : word_cuts[i + 1]])} for i in range(ranges) if cuts[i + 1] > cuts[i] or word_cuts[i + 1] > word_cuts[i]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("prints", pa.binary()), ("common", pa.binary())]))

    return send


def _matcher(n_blocks: int):
    """Rows come sorted by range and block. Tells each block which of its fingerprints another one has, and which words are
    common in most blocks: one row for a range, as each block names a word once."""
    schema = pa.schema([("block", pa.int64()), ("prints", pa.binary()), ("n", pa.int64()), ("common", pa.binary())])

    def shared(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_expanded(raw) for _, raw in rows]
        prints, numbers = np.concatenate(parts), np.unique([b for b, _ in rows])
        if not len(prints):
            return
        block = np.repeat(np.searchsorted(numbers, [b for b, _ in rows]).astype(np.int32), [len(p) for p in parts])
        order = np.argsort(prints)
        prints, block = prints[order], block[order]
        starts = _starts(prints)
        several = np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts)
        keep = np.repeat(several, np.diff([*starts, len(prints)]))
        prints, block = prints[keep], block[keep]
        by_block = np.argsort(block, kind="stable")
        prints, block = prints[by_block], block[by_block]
        edges = _starts(block)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=False):
            own = _distinct(prints[a:b])
            yield pa.RecordBatch.from_pylist([{"block": int(numbers[block[a]]), "prints": _pressed(own), "n": len(own)}], schema)

    def in_most(named: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = np.sort(np.concatenate([_expanded(raw) for raw in named]))
        starts = _starts(words)
        often = words[starts[np.diff([*starts, len(words)]) * 2 > n_blocks]]
        if len(often):
            yield pa.RecordBatch.from_pylist([{"common": packed(often)}], schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, named = None, [], []
        for batch in batches:
            for own, block, raw, common in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "prints", "common")), strict=True):
                if own != group and rows:
                    yield from shared(rows)
                    yield from in_most(named)
                    rows, named = [], []
                group = own
                rows.append((block, raw))
                named.append(common)
        if rows:
            yield from shared(rows)
            yield from in_most(named)

    return match


# ---- suffixes to groups, trees -------------------------------------------------------------------------------------


def prefix_groups(suffixes: np.ndarray, hashes: np.ndarray, common: np.ndarray, rare: int, groups: int) -> np.ndarray:
    """Groups of suffixes (rows of word numbers): by the words with the rare least hashes of those that aren't common (if
    fewer aren't, by all words). Suffixes that begin near each other mostly have the same ones, wherever these are, so they are
    in one group and sent as one passage. hashes, common: of each word by its number."""
    last = np.uint64((1 << 64) - 1)
    rank = np.where(common, last, (hashes ^ (hashes >> np.uint64(31))) * _MIX[3])[suffixes]
    least = rank.min(axis=1, keepdims=True) if rare == 1 else np.sort(rank, axis=1)[:, :rare]
    key, few = np.zeros(len(suffixes), np.uint64), np.flatnonzero(least[:, -1] == last)
    for column in least.T:
        key = (key ^ (key >> np.uint64(29))) * _MIX[1] + column * _MIX[0]
    whole = np.zeros(len(few), np.uint64)
    for column in suffixes[few].T:
        whole = (whole ^ (whole >> np.uint64(29))) * _MIX[1] + hashes[column] * _MIX[0]
    key[few] = whole
    return (((key ^ (key >> np.uint64(31))) * _MIX[2] >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)


def _suffix_sender(bits: int, common: np.ndarray, rare: int, groups: int, at_once: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = dict.fromkeys(x.split()[0] for x in _MESSAGE.split(", "))
        schema = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("n_words", pa.int32()), *((c, pa.binary()) for c in ("ids", "steps", "at", "owner", "removed", "extra", "like"))])
        for files, answers in block_rows(batches, ("prints",)):
            block = Block(_texts(files.batches(["id", "text"])))
            block.sort_words()
            prints = block.prints()
            windows, starts = block.nodes(prints)
            n = np.diff([*starts, len(windows)])
            # A node's first window is that of its smallest id; the others of that id follow it, those of larger ids go.
            node = np.repeat(np.arange(len(starts)), n)
            order = np.lexsort((windows, block.owner[windows], node))
            windows = windows[order]
            first = np.repeat(windows[starts], n) if len(starts) else windows
            same = block.owner[windows] == block.owner[first]
            removed, more = np.sort(windows[~same]), same & (windows != first)
            extra, like = windows[more], first[more]
            sole = np.ones(len(prints), bool)
            sole[windows] = False
            sole[first] = True
            told = _distinct(np.concatenate([_expanded(p) for (p,) in answers])) if answers else np.empty(0, np.uint64)
            own = np.flatnonzero(sole)
            if len(told):
                cut = prints[own] >> np.uint64(64 - bits)
                own = own[told[np.minimum(np.searchsorted(told, cut), len(told) - 1)] == cut]
            else:
                own = own[:0]
            rows, held = [], 0
            for group, some in parted(block, own):
                words, n_words, ids, steps = written(block, some)
                rows.append(nothing | {"grp": group, "block": files.block, "n_words": n_words, "words": words, "ids": ids, "steps": steps, "at": _pressed(some), "owner": _squeezed(block.owner[some])})
                held += len(words) + len(ids) + 16 * len(some)
                if held > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if len(removed) or len(extra):
                rows.append(nothing | {"grp": files.block * 7919 % groups, "block": files.block, "removed": _pressed(removed), "extra": extra.astype("<i8").tobytes(), "like": like.astype("<i8").tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    def parted(block: Block, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The windows of each group, in their order, at_once of them at most at a time."""
        often = np.isin(block.hashes, common)
        parts = range(0, len(own), at_once)
        group = np.concatenate([np.empty(0, np.int64), *(prefix_groups(block.suffixes(own[a : a + at_once]), block.hashes, often, rare, groups) for a in parts)])
        order = np.argsort(group, kind="stable")
        edges = _starts(group[order])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=False):
            for i in range(a, b, at_once):
                yield int(group[order[a]]), own[order[i : min(b, i + at_once)]]

    def written(block: Block, windows: np.ndarray) -> tuple[bytes, int, bytes, bytes]:
        """The distinct words of some windows in their order, their number, the passages that the windows cover as places in them, and
        how far each window begins after the one before it, compressed."""
        at = block.at[windows]
        steps = np.minimum(np.diff(at, prepend=at[0] - WINDOW), WINDOW)  # a window adds so many words
        ends = np.cumsum(steps)
        numbers = block.number[np.repeat(at + WINDOW - ends, steps) + np.arange(ends[-1])]
        if 8 * len(numbers) < len(block.words):
            used, ids = np.unique(numbers, return_inverse=True)
        else:
            place = np.zeros(len(block.words), np.uint32)
            place[numbers] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used), dtype=np.uint32)
            ids = place[numbers]
        width = 1 if len(used) <= 256 else 2 if len(used) <= 1 << 16 else 4
        ids = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
        return _fronted(block.words.take(pa.array(used))), len(used), _compressed(ids), _compressed(steps.astype(np.uint8).tobytes())

    return send


def _trees(at_once: int):
    """Rows come sorted by group. Tells each block which of its suffixes lie below a deep node with a smaller doc_id of
    another block; what blocks found by themselves is passed on. A group of more suffixes than at_once is split by whole
    windows, one part after the other."""
    schema = pa.schema([("block", pa.int64()), ("removed", pa.binary()), ("extra", pa.binary()), ("like", pa.binary())])

    def grown(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts, places, owners, blocks = [], [], [], []
        for block, words, n_words, _, _, at, owner in rows:
            texts.append(_unfronted(words, n_words))
            places.append(_expanded(at).astype(np.int64))
            owners.append(_unsqueezed(owner, len(places[-1])))
            blocks.append(np.full(len(places[-1]), block, np.int64))
        numbers = pa.chunked_array(texts).dictionary_encode()
        numbers = np.concatenate([c.indices.to_numpy() for c in numbers.chunks]).astype(np.int32)
        texts.clear()
        pa.default_memory_pool().release_unused()
        parts = -(-sum(map(len, places)) // at_once)
        for part in range(parts):
            matrix, which, first = [], [], 0
            for (_, _, n_words, raw, steps, _, _), at in zip(rows, places, strict=True):
                width = 1 if n_words <= 256 else 2 if n_words <= 1 << 16 else 4
                steps = np.frombuffer(pa.decompress(steps, len(at), "zstd", asbytes=True), np.uint8)
                ends = np.cumsum(steps, dtype=np.int64)
                planes = np.frombuffer(pa.decompress(raw, width * int(ends[-1]), "zstd", asbytes=True), np.uint8).reshape(width, -1)
                ids = np.zeros((planes.shape[1], 4), np.uint8)
                ids[:, :width] = planes.T
                passage = numbers[first : first + n_words][ids.view("<u4").ravel()]
                suffixes = np.stack([passage[ends - WINDOW + j] for j in range(WINDOW)])
                first += n_words
                if parts > 1:
                    some = np.flatnonzero((sum(c * m for c, m in zip(suffixes.astype(np.uint64), _MIX, strict=True)) >> np.uint64(33)) % np.uint64(parts) == np.uint64(part))
                    suffixes = suffixes[:, some]
                else:
                    some = slice(None)
                matrix.append(suffixes)
                which.append(some)
            yield from told(np.concatenate(matrix, axis=1).T, *(np.concatenate([x[w] for x, w in zip(xs, which, strict=True)]) for xs in (places, owners, blocks)))

    def told(matrix: np.ndarray, place: np.ndarray, owner: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(matrix):
            return
        order, shared = subtree(matrix)
        place, owner, block = place[order], owner[order], block[order]
        starts = np.flatnonzero(shared < WINDOW)
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff([*starts, len(order)]))
        go = np.flatnonzero(owner > least)
        go = go[np.lexsort((place[go], block[go]))]
        edges = _starts(block[go])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(go)], strict=False):
            yield pa.RecordBatch.from_pylist([{"block": int(block[go[a]]), "removed": _pressed(place[go[a:b]])}], schema)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in small(batches):
            for own, *row, removed, extra, like in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "words", "n_words", "ids", "steps", "at", "owner", "removed", "extra", "like")), strict=True):
                if own != group and rows:
                    yield from grown(rows)
                    rows = []
                group = own
                if removed is not None:
                    yield pa.RecordBatch.from_pylist([{"block": row[0], "removed": removed, "extra": extra, "like": like}], schema)
                else:
                    rows.append(tuple(row))
        if rows:
            yield from grown(rows)

    return grow


# ---- what is left --------------------------------------------------------------------------------------------------


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked; each word that stays keeps the white space after it."""
    if not gone.any():
        return text
    spans = [m.span() for m in _WORDS.finditer(text)]
    ends = [a for a, _ in spans[1:]] + [spans[-1][1]]
    return b"".join(text[a:e] for (a, _), e, g in zip(spans, ends, gone.tolist(), strict=True) if not g).rstrip(b" \t\n\r\x0b\x0c")


def _runs(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _judge(batch: pa.RecordBatch, split: list[list[bytes]], marks: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of SCHEMA."""
    rows = []
    for doc_id, words, gone in zip(batch.column("id").to_pylist(), split, marks, strict=True):
        kept = b" ".join(words) if not gone.any() else b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        rows.append((doc_id, len(words), int(gone.sum()), _runs(gone), hashlib.sha256(kept).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rewriter(text_col: str, count_col: str | None) -> Callable:
    def rewrite(batch: pa.RecordBatch, split: list[list[bytes]], marks: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        """The rows of the input, their texts without what repeats."""
        given = batch.column("row")
        columns = {given.type.field(i).name: given.field(i) for i in range(given.type.num_fields)}
        texts = [None if t is None else without(t, g).decode() for t, g in zip(batch.column("text").to_pylist(), marks, strict=True)]
        columns[text_col] = pa.array(texts, pa.string())
        if count_col:
            columns[count_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return rewrite


def _window_starts(n: np.ndarray, has_id: np.ndarray) -> np.ndarray:
    """Where windows start, from the texts' numbers of words and whether they have an id."""
    left = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum()))
    return np.flatnonzero((left >= WINDOW) & np.repeat(has_id, n))


def _settler(answer: Callable, schema: pa.Schema, with_row: bool):
    def settle(files: Files, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, has_id = [], []
        for batch in files.batches(["id", "text"]):
            has_id.append(pc.is_valid(batch.column("id")).to_numpy(zero_copy_only=False))
            n.append(np.fromiter((len(t.split()) if t else 0 for t in batch.column("text").to_pylist()), np.int64, len(batch)))
        n = np.concatenate(n)
        gone = np.zeros(int(n.sum()) + 1, np.int64)
        at = _window_starts(n, np.concatenate(has_id))[removed]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + WINDOW, -1)
        gone, first = np.cumsum(gone[:-1]) > 0, 0
        for batch in files.batches(["id", "text"] + ["row"] * with_row):
            split = [(t or b"").split() for t in batch.column("text").to_pylist()]
            marks = []
            for words in split:
                marks.append(gone[first : first + len(words)])
                first += len(words)
            yield answer(batch, split, marks, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, answers in block_rows(batches, ("removed", "extra", "like")):
            removed = _distinct(np.concatenate([np.empty(0, np.int64), *(_expanded(r).astype(np.int64) for r, _, _ in answers)]))
            extra, like = (np.frombuffer(b"".join(a[i] or b"" for a in answers), "<i8") for i in (1, 2))
            yield from settle(files, np.union1d(removed, extra[np.isin(like, removed)]))

    return run


def _settled(docs: DataFrame, id_col: str, text_col: str, answer: Callable, out: T.StructType, with_row: bool, block_bytes: int, group_suffixes: int, spare: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")]
    if with_row:
        columns.append(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    blocks = in_blocks(docs.select(*columns), "text", block_bytes, "blocks")
    files = files_of(blocks)
    size = blocks.agg(F.sum(F.length("text")).alias("n"), F.count_distinct("block").alias("blocks")).first()
    n_bytes, n_blocks = size.n or 0, max(1, size.blocks)
    bits = min(64, max(2, max(1, n_bytes // 2).bit_length() + spare))
    ranges = max(1, -(-n_bytes // RANGE_BYTES))
    printed = blocks.select("block", "id", "text").mapInArrow(_printer(bits, ranges), "grp long, block long, prints binary, common binary")
    matched = stored(printed.repartition(ranges, "grp").sortWithinPartitions("grp", "block").mapInArrow(_matcher(n_blocks), "block long, prints binary, n long, common binary"), "prints")
    left = matched.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-left // group_suffixes))
    # Those that are common in most blocks: as a block names COMMON_SHARE of them at most, there are twice as many at most.
    found = matched.filter("common IS NOT NULL").select("common").collect()
    common = np.sort(np.concatenate([np.empty(0, np.uint64), *(unpacked(r.common) for r in found)]))
    rare = 1
    while COMMON_SHARE**rare < 8 * groups:
        rare += 1
    told = matched.filter("prints IS NOT NULL").select("block", "prints")
    sender = _suffix_sender(bits, common, rare, groups, min(SENT_AT_ONCE, group_suffixes))
    sent = met(files, told, n_blocks).mapInArrow(sender, _MESSAGE)
    trees = sent.repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_trees(min(TREE_SUFFIXES, 2 * group_suffixes)), "block long, removed binary, extra binary, like binary")
    return met(files, trees, n_blocks).mapInArrow(_settler(answer, to_arrow_schema(out), with_row), out)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES, spare: int = SPARE) -> DataFrame:
    """SCHEMA: per row, its words, those removed (also as ranges of words) and the digest of what is kept."""
    out = T.StructType.fromDDL(SCHEMA)
    return _settled(docs.select(id_col, text_col), id_col, text_col, _judge, out, False, block_bytes, group_suffixes, spare)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES, spare: int = SPARE) -> DataFrame:
    """docs with the repeated words taken out of text_col, all other columns kept; count_col, if named, gets the new length."""
    return _settled(docs, id_col, text_col, _rewriter(text_col, count_col), docs.schema, True, block_bytes, group_suffixes, spare)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(read_table(spark, sf_dir, "documents")).drop("removed")
