"""Column functions that the operators are made of. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import S


def substituted(text: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """The text after each (pattern, replacement), in order."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def guarded(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where ``needed`` holds, the text itself elsewhere. needed is a cheap test, true wherever change changes anything.

    The text is bound to a variable first, so that it is computed once though it is mentioned three times."""
    return F.get(F.transform(F.array(text), lambda t: F.when(needed(t), change(t)).otherwise(t)), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: for dear work on a small input that is a few files.

    An input with more partitions is left as it is; at scale nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trimmed(text: Column) -> Column:
    """Without white space (of any kind) at the ends."""
    return F.regexp_replace(text, rf"^[{S}]+|[{S}]+$", "")


def words(text: Column) -> Column:
    """Runs of anything but white space; none in an empty text."""
    return F.filter(F.split(text, rf"[{S}]+"), lambda w: w != "")


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def share(part: Column, of: Column) -> Column:
    """Size of one array over that of another; 0 where that is empty."""
    return F.when(F.size(of) > 0, F.size(part) / F.size(of)).otherwise(0.0)


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later expressions mention them.

    The optimizer would else merge later filters and projections into this one and repeat a chain of some hundred
    replacements in each; it doesn't move expressions through a generator.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made.alias("_made")).select(*kept, *[F.col(f"_made.{n}").alias(n) for n in columns])
