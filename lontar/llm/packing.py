"""Harmonic packing of documents into sequences of a fixed capacity.

A document's length (its ids and an end token; of a longer document what whole capacities leave) puts it into a
reciprocal-capacity class: class j = capacity // length, and a bin of class j takes exactly j documents of it, whatever
else arrives. Each worker fills the bins of its own rows with no knowledge of others and no shuffle. What a full bin
leaves free waits to be filled: documents that have no class (shorter than ``least``), and, as soon as it fits the room
that waits, the document at hand, are cut into pieces for the waiting bins; so most documents stay whole and sequences are
still full. Room of less than ``least`` tokens isn't worth a cut and stays padding. When a worker's rows end, documents in
bins that are not full fill the waiting room, and what is left is strung together and cut at the capacity, the last of it
into powers of two, which need no padding.

Null texts are empty documents: one end token. Repeated rows are packed each for itself. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder
from .shared import read_table, small

CAPACITY = 2048
MIN_PIECE = 32
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """Bins of one worker. rows: finished pieces, as in SCHEMA. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first: int, capacity: int = CAPACITY, least: int = MIN_PIECE):
        self.next, self.capacity, self.least = first, capacity, least
        self.open: dict[int, list[tuple]] = {}  # class: documents, fewer than the class takes
        self.waiting: deque[tuple[list[tuple], int]] = deque()  # full bins and the room they leave
        self.room = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def full(self, pieces: list[tuple]) -> None:
        room = self.capacity - sum(len(p[2]) for p in pieces) // 4
        if room < max(1, self.least):
            self.close(pieces)
        else:
            self.waiting.append((pieces, room))
            self.room += room

    def fill(self, piece: tuple) -> None:
        """Cut a piece over the waiting room, which must be enough for it."""
        doc_id, start, ids, total = piece
        while ids:
            bin_, room = self.waiting.popleft()
            n = min(room, len(ids) // 4)
            bin_.append((doc_id, start, ids[: 4 * n], total))
            self.room -= n
            start, ids, room = start + n, ids[4 * n :], room - n
            if room < max(1, self.least):
                self.room -= room
                self.close(bin_)
            else:
                self.waiting.appendleft((bin_, room))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            self.close([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], total)])
            start += self.capacity
        n = total - start
        if not n:
            return
        piece = (doc_id, start, ids[4 * start :], total)
        j = self.capacity // n
        # Room below `least` may be left in each bin that the piece ends, so a little more than its length must wait.
        if n + self.least <= self.room:
            self.fill(piece)
            return
        if n < self.least:
            j = 0  # documents without a class: kept until room waits or the rows end
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if j and len(bin_) == j:
            del self.open[j]
            self.full(bin_)
        elif not j and len(bin_) == self.capacity // self.least:
            del self.open[j]
            self.full(bin_)

    def finish(self) -> None:
        left = [p for _, bin_ in sorted(self.open.items()) for p in bin_]
        self.open.clear()
        while left and len(left[-1][2]) // 4 + self.least <= self.room:
            self.fill(left.pop())
        # What waits with much room is strung together with the rest.
        for bin_, _ in self.waiting:
            left += bin_
        self.waiting.clear()
        self.room = 0
        room, pieces, rest = 0, [], sum(len(p[2]) // 4 for p in left)
        for doc_id, start, ids, total in left:
            while ids:
                if not room:
                    room = size = min(self.capacity, 1 << (rest.bit_length() - 1))
                    rest -= size
                n = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * n], total))
                start, ids, room = start + n, ids[4 * n :], room - n
                if not room:
                    self.close(pieces)
                    pieces = []


def _packed(path: str, capacity: int, least: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(path).ids, np.array([END_ID], np.uint32).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, least)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(_NAMES)
            packer.rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)

        for batch in small(batches):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids(batch.column("text")), strict=True):
                packer.add(doc_id, own + end)
            yield out()
        packer.finish()
        yield out()

    return pack


def harmonic_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = MIN_PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, with their sequences. capacity must be a power of two; least is the shortest document
    with a class of its own, and the least room that a document is cut for."""
    if capacity & (capacity - 1) or not 0 < least <= capacity:
        raise ValueError("capacity must be a power of two, and least between 1 and it")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(_packed(tokenizer, capacity, least), SCHEMA)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
