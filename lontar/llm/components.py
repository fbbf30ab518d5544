"""Connected components of links that no machine has to hold: alternating large and small stars.

Each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and itself
to the smallest (small star), until the links form stars. Rounds grow with the logarithm of the longest path. A node
with very many links is a key of joins only, whose large partitions Spark splits, and of minima that are taken where
the rows lie first. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _joined_to_least(sides: DataFrame, least: DataFrame) -> DataFrame:
    """sides(x, y) with each x's m. Both are dealt out by the join alone, so that Spark can split a large x."""
    return sides.join(stored(least, "least"), "x")


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: every node of the links (pairs of longs, in any order and number) with the smallest node it reaches."""
    now = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _joined_to_least(both, least).filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        sides = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        small = _joined_to_least(sides, least).filter("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
