"""SimHash near-duplicates by a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank, so that neighbours share bits, and dealt in that order to groups of about
GROUP. A group's shared bits (a mask and their pattern) are its node; a tree over the groups' nodes, whose upper nodes
hold the bits that all below share and whose lower nodes only the further ones, sends each fingerprint to the groups
that may hold a neighbour: differences add up on the way down, and a node beyond the limit is left with all below it.
Each group builds the same tree over its own fingerprints and is searched by its visitors likewise. A pair of groups is
searched from one side. A search returns the links as stars of what it found connected, never all pairs; the stars of
all groups make the components.

Null texts and texts without a word have fingerprint zero and link like others. Repeated rows link to each other. Null
ids take part in no minimum; a component without any id has none. An empty table gives an empty result; other columns
play no part. Links are found between distinct fingerprints, however many documents have one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import read_table, small, stored, text_bytes

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Fingerprints in a group; children of a node; members under a lowest node; visitors searched at once.
GROUP, FAN, LEAF, VISITORS = 1 << 17, 8, 16, 1024
#: Groups at most (their shared bits are sent to all tasks, 24 bytes each); beyond it, groups are larger.
MAX_GROUPS = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        f = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(column: str):
    """The rank of a code word in Gray order, with the top bit flipped so that longs sort like unsigned numbers."""
    r = F.col(column)
    for shift in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, shift))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


class Index:
    """The tree over patterns in Gray order. mask, value: the bits that are fixed in each lowest element, and they."""

    def __init__(self, mask: np.ndarray, value: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        levels, width = [(mask, value & mask)], leaf
        while len(levels[-1][0]) > 1:
            m, v = levels[-1]
            starts = np.arange(0, len(m), width)
            one, zero = np.bitwise_and.reduceat(m & v, starts), np.bitwise_and.reduceat(m & ~v, starts)
            levels.append((one | zero, one))
            width = fan
        self.sizes = [len(m) for m, _ in levels]
        self.widths = [leaf] + [fan] * (len(levels) - 2)  # of the children below level 1, 2, ...
        self.levels = []
        for i, (m, v) in enumerate(levels):  # a node keeps the bits that its parent does not share
            if i + 1 < len(levels):
                above = np.repeat(levels[i + 1][0], self.widths[i])[: len(m)]
                m = m & ~above
            self.levels.append((m, v & m))

    def search(self, queries: np.ndarray, most: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indices of queries and of lowest elements that differ in at most ``most`` fixed bits (from element first[query] on)."""
        top = len(self.levels) - 1
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        m, v = self.levels[top]
        seen = np.bitwise_count((queries ^ v[0]) & m[0]).astype(np.int64) if self.sizes[top] else np.empty(0, np.int64)
        keep = seen <= most
        query, node, seen = query[keep[: len(query)]], node[keep[: len(node)]], seen[keep]
        below = int(np.prod(self.widths, dtype=np.int64)) if self.widths else 1
        for level in range(top - 1, -1, -1):
            width = self.widths[level]
            below //= width
            node = (node[:, None] * width + np.arange(width)).ravel()
            query, seen = np.repeat(query, width), np.repeat(seen, width)
            keep = node < self.sizes[level]
            if first is not None:
                keep &= (node + 1) * below > first[query]
            node, query, seen = node[keep], query[keep], seen[keep]
            m, v = self.levels[level]
            seen = seen + np.bitwise_count((queries[query] ^ v[node]) & m[node])
            keep = seen <= most
            node, query, seen = node[keep], query[keep], seen[keep]
        return query, node


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a[i] - b[i] as links of each node to the smallest that it reaches in them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
        if np.array_equal(root, before):
            break
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _router(sent, most: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, value, numbers = sent.value
        tree = Index(mask, value, leaf=FAN)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.searchsorted(numbers, batch.column("grp").to_numpy(zero_copy_only=False))  # empty ranges have no number
            for at in range(0, len(fp), VISITORS):
                q, g = tree.search(fp[at : at + VISITORS], most, own[at : at + VISITORS])
                visitor = g != own[at + q]
                q, g = at + q[visitor], g[visitor]
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(np.ones(len(q), bool)), pa.array(fp[q].view(np.int64))], ["grp", "visitor", "fp"])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(len(fp), bool)), pa.array(fp.view(np.int64))], ["grp", "visitor", "fp"])

    return route


def _rank(fp: np.ndarray) -> np.ndarray:
    r = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def _searcher(most: int):
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)

    def links(index: Index, members: np.ndarray, visitors: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(visitors), VISITORS):
            some = visitors[at : at + VISITORS]
            first = np.arange(at, at + len(some)) if own else None
            q, m = index.search(some, most, first)
            a, b = some[q], members[m]
            far = a != b
            u, v = stars(a[far].view(np.int64), b[far].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, members before visitors."""
        group, index, collected, members = None, None, [], np.empty(0, np.uint64)

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal index, members
            if index is None and collected:
                members = np.concatenate(collected)
                members = members[np.argsort(_rank(members))]
                index = Index(np.full(len(members), everything), members)
                yield from links(index, members, members, True)

        for batch in batches:
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if a == b:
                    continue
                if grp[a] != group:
                    yield from built()
                    group, index, collected = grp[a], None, []
                if not visitor[a]:
                    collected.append(fp[a:b].copy())
                else:
                    yield from built()
                    yield from links(index, members, fp[a:b], False)
        yield from built()

    return search


def near_links(distinct: DataFrame, most: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """u, v: stars that connect exactly what the links between the distinct fingerprints (fp) connect."""
    spark = distinct.sparkSession
    n = distinct.count()
    groups = min(MAX_GROUPS, max(1, -(-n // group)))
    dealt = distinct.withColumn("_rank", gray_rank("fp")).repartitionByRange(groups, "_rank")
    grouped = stored(dealt.select("fp", F.spark_partition_id().alias("grp"), "_rank"), "gray")
    # One row per group, MAX_GROUPS at most: their shared bits, by place in Gray order.
    rows = grouped.groupBy("grp").agg(F.bit_and("fp").alias("one"), F.bit_or("fp").alias("some"), F.min("_rank").alias("r")).orderBy("r").collect()
    one, some = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("one", "some"))
    numbers = [r.grp for r in rows]
    if numbers != sorted(numbers):
        raise RuntimeError("groups are not in Gray order")
    sent = spark.sparkContext.broadcast((one | ~some, one, np.array(numbers, np.int64)))
    routed = grouped.select("fp", "grp").mapInArrow(_router(sent, most), "grp int, visitor boolean, fp long")
    return routed.repartition("grp").sortWithinPartitions("grp", "visitor").mapInArrow(_searcher(most), "u long, v long")


def named(found: DataFrame, most: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """fp, component_id for each distinct fingerprint of found(doc_id, fp), and the component's root."""
    least = stored(found.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = components(near_links(least.select("fp"), most, group))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "roots")
    firsts = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "firsts")
    return stored(rooted.join(firsts, "root").select("fp", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    found = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    return found.join(named(found, most, group).drop("root"), "fp").select("doc_id", "fp", "component_id")


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        f = np.array([fingerprint(t) for t in batch.column("_bytes").to_pylist()], np.uint64)
        yield batch.drop_columns(["_bytes"]).append_column("_fp", pa.array(f.view(np.int64)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (of several such rows, one with the
    smallest fingerprint; of a component without any doc_id, one row)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])
    marked = stored(docs.withColumn("_bytes", text_bytes(text_col)).mapInArrow(_with_fingerprint, schema), "documents")
    found = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_fp").alias("fp"))
    joined = found.join(named(found, most, group), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(joined.groupBy("root").agg(F.min("fp").alias("_kept_fp"), F.min("doc_id").alias("_kept_id")), "kept")
    same = (marked["_fp"] == kept["_kept_fp"]) & marked[id_col].cast("long").eqNullSafe(kept["_kept_id"])
    out = marked.join(kept, same, "left_semi")
    if found.count() > found.distinct().count():  # rows repeated with id and text
        out = out.dropDuplicates([id_col, "_fp"])
    return out.drop("_fp")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
