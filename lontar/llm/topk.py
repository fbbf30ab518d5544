"""Exact top-k inner products over integer vectors, by norm order and residual bounds.

Components become floor(scale * x). Vectors are stored in order of descending length. An orthogonal rotation, from the
singular vectors of all of them (the eigenvectors of their d x d moment matrix, summed where they lie), moves most of
the products into the first coordinates: a partial sum over those, plus the product of the residual lengths
(Cauchy-Schwarz), bounds a score from above. Queries are taken in blocks of a bounded number and sent to every task; a
task passes over its vectors from the longest down, leaves out a batch for queries that even its longest vector can't
serve, then pairs whose bound is below the query's k-th score so far, and computes the rest exactly in integers. The
bounds start from the exact scores of the longest vectors of all.

Vectors that are null or hold a null or non-finite component take no part. Only vectors of a query's dimension are its
candidates. Ties go to the smaller id. Rows with a query's own id are not its candidates; rows repeated under one id
count each; a query repeated with the same vector is answered once. Scores and components beyond 64 bits are held at
its ends. Rows without an id take no part. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read_table, stored

K = 10
SCALE = 1024.0
#: Queries sent to the tasks at once, and longest vectors that the bounds start from.
QUERY_BLOCK, SEED_ROWS = 2048, 1024
#: Dimensions of the first and second partial sums, as shares of all.
HEADS = (0.25, 0.5)
_OUT = "query long, query_id long, vec_id long, score long"
_LIMIT = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm2 of the vectors that take part."""
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
        .filter(v.isNotNull() & finite & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _moments(d: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d).astype(float)
            total += x.T @ x
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return add


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthonormal columns, from the direction that holds most of the vectors' length to that which holds least."""
    rows = vectors.select("v").mapInArrow(_moments(d), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    moment = np.zeros((d, d))
    for r in rows:
        moment[r.i, r.j] = r.s
    top = np.abs(moment).max() if rows else 0.0
    return np.linalg.eigh(moment / top if top > 0 else moment)[1][:, ::-1]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row inner products of two integer matrices, in 64 bits (held at their ends where they don't fit)."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = float(np.abs(x.astype(float)).max()) * float(np.abs(q.astype(float)).max()) * x.shape[1]
    if most < 2.0**62:
        return np.einsum("ij,ij->i", x, q)
    full = (x.astype(object) * q.astype(object)).sum(axis=1)
    return np.array([min(max(s, -_LIMIT - 1), _LIMIT) for s in full], np.int64)


class Best:
    """The k best (score, id) of each query, best first."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
        self.least = np.full(n, -np.inf)  # what a score must reach

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(query):
            return
        order = np.argsort(query, kind="stable")
        query, score, vec_id = query[order], score[order], vec_id[order]
        which, starts = np.unique(query, return_index=True)
        for j, a, b in zip(which.tolist(), starts.tolist(), [*starts[1:].tolist(), len(query)], strict=True):
            s, v = np.concatenate([self.found[j][0], score[a:b]]), np.concatenate([self.found[j][1], vec_id[a:b]])
            top = np.lexsort((v, -s if s.min(initial=0) > -_LIMIT else ~s))[: self.k]
            self.found[j] = s[top], v[top]
            if len(top) == self.k:
                last = float(s[top[-1]])  # beyond 2^53 it may be rounded up
                self.least[j] = max(self.least[j], last if abs(last) < 2.0**53 else np.nextafter(last, -np.inf))


class Search:
    """A block of queries, ready to meet batches of vectors."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.turn, self.k = ids, q, turn, k
        d = q.shape[1]
        self.heads = sorted({max(1, int(d * h)) for h in HEADS}) if d else []
        self.rotated = q.astype(float) @ turn
        self.norm = np.sqrt((self.rotated**2).sum(axis=1))
        self.rest = [np.sqrt((self.rotated[:, h:] ** 2).sum(axis=1)) for h in self.heads]

    def pairs(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of rows of x and of queries, of all pairs whose score may reach least[query]."""
        y = x.astype(float) @ self.turn
        norm = np.sqrt((y**2).sum(axis=1))
        slack = 1e-9 * self.norm * norm.max(initial=0.0) + 1e-6  # covers rounding
        least = least - slack
        active = np.flatnonzero(self.norm * norm.max(initial=0.0) >= least)
        if not self.heads or not len(active):
            row, query = np.indices((len(x), len(active))).reshape(2, len(x) * len(active))
            return row, active[query]
        h, rest = self.heads[0], np.sqrt((y[:, self.heads[0] :] ** 2).sum(axis=1))
        bound = y[:, :h] @ self.rotated[active, :h].T + rest[:, None] * self.rest[0][active]
        row, query = np.nonzero(bound >= least[active])
        partial, query = (bound[row, query] - rest[row] * self.rest[0][active][query]), active[query]
        for h0, h1, rest_q in zip(self.heads, self.heads[1:], self.rest[1:], strict=False):
            rest = np.sqrt((y[:, h1:] ** 2).sum(axis=1))
            partial = partial + np.einsum("ij,ij->i", y[row, h0:h1], self.rotated[query, h0:h1])
            keep = partial + rest[row] * rest_q[query] >= least[query]
            row, query, partial = row[keep], query[keep], partial[keep]
        return row, query

    def meet(self, ids: np.ndarray, x: np.ndarray, best: Best) -> None:
        for a in range(0, len(x), 512):  # bounds the memory
            row, query = self.pairs(x[a : a + 512], best.least)
            other = ids[a + row] != self.ids[query]
            row, query = a + row[other], query[other]
            for b in range(0, len(row), 1 << 16):
                r, j = row[b : b + (1 << 16)], query[b : b + (1 << 16)]
                score = exact(x[r], self.q[j])
                ok = score >= best.least[j]
                best.add(j[ok], score[ok], ids[r[ok]])


def _scan(search, d: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, first, seeds = search.value
        best = Best(len(s.ids), s.k)
        best.least[:] = seeds
        for batch in batches:
            s.meet(batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), d), best)
        n = [len(f[0]) for f in best.found]
        j = np.repeat(np.arange(len(n)), n)
        score, vec = (np.concatenate([f[i] for f in best.found]) if n else np.empty(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(first + j), pa.array(s.ids[j]), pa.array(vec), pa.array(score)], [c.split()[0] for c in _OUT.split(", ")])

    return scan


def top_k(vectors: DataFrame, query_filter, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. query_filter: a condition over vec_id; the rows that meet it are the queries."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vec_col, scale)
    ordered = stored(whole.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"), "vectors")
    queries = ordered.filter(query_filter).select("vec_id", "v").distinct()
    plan = [(r.d, r.n) for r in queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    parts, first = [], 0
    for d, n in sorted(plan):
        same = ordered.filter(F.size("v") == d)
        turn = rotation(same, d)
        longest = same.orderBy(F.desc("norm2"), "vec_id").limit(SEED_ROWS).collect()
        long_ids, long_x = np.array([r.vec_id for r in longest], np.int64), np.array([r.v for r in longest], np.int64).reshape(len(longest), d)
        blocks = -(-n // query_block)
        for block in range(blocks):
            rows = queries.filter((F.size("v") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).collect()
            if not rows:
                continue
            search = Search(np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.int64).reshape(len(rows), d), turn, k)
            best = Best(len(rows), k)
            search.meet(long_ids, long_x, best)
            sent = spark.sparkContext.broadcast((search, first, best.least))
            first += len(rows)
            found = same.select("vec_id", "v").mapInArrow(_scan(sent, d), _OUT)
            parts.append(stored(found, "top") if blocks > 1 else found)
    if not parts:
        return spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
