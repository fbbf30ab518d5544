"""Byte-level BPE by recursive queries in DuckDB, one database per worker.

Texts are split by the vocabulary's pattern. A worker's new pieces become rows (word, position, token), one per byte. Each
round of the recursion joins every pair of neighbours to the merge table and contracts each word's pairs of least rank
from the left: all of them at once, in a run of equal tokens every other one, which gives the same as one after the other,
as a token made in a round can't make a pair of lower rank (every token of the vocabulary is what its own bytes encode
to; a test goes through all of them). A word without a pair that merges is finished. The tokens come back in order of
position; all of a query's are written as decimals and decoded at once, by the vocabulary's bytes. Results are kept by
piece, in a bounded cache.

A word is a piece, or a part of one: pieces are cut between two bytes that stand side by side in no token, as no merge can
ever reach across. So the number of rounds follows the longest stretch without such a place, not a piece's length, and a
hundred thousand equal characters take some ten rounds.

Null and empty texts have no ids and decode to nothing; repeated rows give repeated results; null ids stay null; an
empty table gives an empty result; other columns play no part. Special strings in texts are ordinary text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import FIRST, Encoder
from .shared import read_table, small

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces of one recursive query, by bytes; what a worker remembers.
QUERY_BYTES, REMEMBERED = 600_000, 2_000_000
#: Bytes of text that are worked on together.
NUMBERED = 16 << 20

#: Rows are linked by nxt. Each round: the pairs that merge, the least rank of each word, its pairs of that rank; of those in a
#: run of equal tokens (where they overlap) every other one from the left, the others wait.
_QUERY = """
WITH RECURSIVE step(word, pos, tok, nxt, done) AS (SELECT word, pos, tok, nxt, false FROM start UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT a.word, a.pos, a.tok, a.nxt, b.tok AS r, b.nxt AS after, m.id AS rank
    FROM (FROM step WHERE NOT done) a LEFT JOIN step b ON b.pos = a.nxt LEFT JOIN merges m ON m.pair = a.tok::BIGINT * 1048576 + b.tok),
  least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
  ranked AS MATERIALIZED (SELECT pairs.*, least.rank AS least FROM pairs JOIN least ON pairs.word = least.word),
  equal AS (SELECT *, sum(first::INT) OVER (ORDER BY pos) AS run FROM (SELECT pos, lag(nxt, 1, -1) OVER (ORDER BY pos) IS DISTINCT FROM pos AS first FROM ranked WHERE rank = least AND tok = r)),
  wait AS (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY run ORDER BY pos) AS k FROM equal) WHERE k % 2 = 0),
  judged AS MATERIALIZED (SELECT p.*, coalesce(p.rank = p.least, false) AND w.pos IS NULL AS chosen FROM ranked p LEFT JOIN wait w ON w.pos = p.pos)
  SELECT word, pos, CASE WHEN chosen THEN rank ELSE tok END, CASE WHEN chosen THEN after ELSE nxt END, least IS NULL
  FROM judged WHERE NOT EXISTS (SELECT 1 FROM judged g WHERE g.chosen AND g.nxt = judged.pos)))
SELECT pos, tok FROM step WHERE done ORDER BY pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Strings:
    """Byte strings by number, side by side."""

    def __init__(self, strings: list[bytes]):
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of some numbers, one after the other, and where each begins (and the last one ends)."""
        size = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.raw[np.repeat(self.at[numbers] - ends[:-1], size) + np.arange(ends[-1])].tobytes(), ends


class Bpe(Encoder):
    """rows(texts): (number of ids, the ids as decimal text, the bytes they decode to) of each text."""

    numbered = NUMBERED

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # White space as the vocabulary's own library has it.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cuts = pattern == public_tokenizers.PATTERN
        gc.set_threshold(200_000, 50, 100)  # the caches hold no cycles; walking through them often costs much
        self.known, self.old, self.pieces, self.remembered = {}, {}, {}, 500_000
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        pair, made = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pair.append(left * 1048576 + right)
                    made.append(rank)
        raw = np.frombuffer(b"".join(self.ranks), np.uint8).astype(np.int64)
        inside = np.ones(len(raw), bool)
        inside[np.cumsum(np.fromiter(map(len, self.ranks), np.int64, len(self.ranks))) - 1] = False
        self.side_by_side = np.zeros(1 << 16, bool)
        self.side_by_side[(raw[:-1] * 256 + raw[1:])[inside[:-1]]] = True
        self._table("merges", pair=pa.array(pair, pa.int64()), id=pa.array(made, pa.int32()))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.decimals, self.bytes = Strings([b"%d " % i for i in range(len(tokens))]), Strings(tokens)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _query(self, pieces: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1
        end = np.ones(len(raw), bool)  # of a word
        end[:-1] = ~self.side_by_side[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        end[last] = True
        pos = np.arange(len(raw), dtype=np.int32)
        ends = np.flatnonzero(end)
        word = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=-1))
        self.db.register("start", pa.table({"word": word, "pos": pos, "tok": self.byte[raw], "nxt": np.where(end, -1, pos + 1).astype(np.int32)}))
        found = self.db.execute(_QUERY).fetchnumpy()
        self.db.unregister("start")
        tok, edges = found["tok"], np.searchsorted(found["pos"], last, "right")  # of the pieces
        (ids, ids_at), (decoded, decoded_at) = self.decimals.joined(tok), self.bytes.joined(tok)
        at, count = [0, *ids_at[edges].tolist()], np.diff(edges, prepend=0).tolist()
        if decoded == raw.tobytes() and (decoded_at[edges] == last + 1).all():
            kept = pieces  # one copy in memory
        else:
            ends = [0, *decoded_at[edges].tolist()]
            kept = [decoded[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for piece, n, a, b, back in zip(pieces, count, at[:-1], at[1:], kept, strict=True):
            self.pieces[piece] = n, ids[a : b - 1], back

    def _encode_pieces(self, new: list[bytes]) -> None:
        group, size = [], 0
        for piece in new:
            group.append(piece)
            size += len(piece)
            if size >= QUERY_BYTES:
                self._query(group)
                group, size = [], 0
        if group:
            self._query(group)

    def _looked_up(self, texts: list[str]) -> list[tuple]:
        lists = [[p.encode() for p in self.split(t)] for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self._encode_pieces(list({p for ps in lists for p in ps}.difference(self.pieces)))
        return [self._joined([self.pieces[p] for p in ps]) for ps in lists]

    @staticmethod
    def _joined(parts: list[tuple]) -> tuple[int, bytes, bytes]:
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return 0, b"", b""
        n, ids, decoded = zip(*parts, strict=True)
        return sum(n), b" ".join(ids), b"".join(decoded)

    def learn(self, words: list[str]) -> None:
        plain = [w[1:] if w[:1] == FIRST else w if w == "\n" else f" {w}" for w in words]
        self.known.update(zip(words, self._looked_up(plain), strict=True))

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        for _, _, some, whole in self._parts(texts):
            if whole:
                for text in some.to_pylist():
                    yield self._looked_up([text])[0]
                continue
            offsets, number, parts = self._cut(some)
            count, ids, decoded = zip(*parts, strict=True)
            counts = np.add.reduceat(np.array(count, np.int64)[number], offsets[:-1]).tolist()
            at = offsets.tolist()
            for n, a, b in zip(counts, at[:-1], at[1:], strict=True):
                own = number[a:b].tolist()
                yield n, b" ".join(map(ids.__getitem__, own)), b"".join(map(decoded.__getitem__, own))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many bytes (but the last): a recursive query has a cost of its own for each round."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_made: dict[tuple, Bpe] = {}


def _runner(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _made:
            _made[path, pattern] = Bpe(path, pattern)
        bpe = _made[path, pattern]
        for batch in gathered(small(batches), NUMBERED):
            n, ids, decoded = [], [], []
            for count, text_ids, text in bpe.rows(batch.column("text")):
                n.append(count)
                ids.append(hashlib.sha256(text_ids).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: number and digest of each text's ids, and digest of what they decode to. ranks: a rank file."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(_runner(ranks, pattern), SCHEMA)


def op8_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
