"""From sentences to training tables: output rows, union, balance, split, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab

SEED = 42


def map_output_columns(sentences: DataFrame) -> list[Column]:
    names = {"Label": "religion", "Denomination": "source", "Location": "region", "Date": None, "Title": None, "Sentence_Unit": "sentence", "Link": "url"}
    have = set(sentences.columns)
    return [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(n) for n, c in names.items()]


def map_output(sentences: DataFrame) -> DataFrame:
    """Corpus rows; missing values are empty strings."""
    return sentences.select(*map_output_columns(sentences))


def map_rejected(sentences: DataFrame) -> DataFrame:
    """Corpus rows with the detected language, ``unknown`` where there is none."""
    return sentences.select(*map_output_columns(sentences), F.coalesce(F.col("detected_lang").cast("string"), F.lit("unknown")).alias("Detected_Language"))


def combine(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, which must have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_ids(df: DataFrame, labels: dict[str, int] | None = None, column: str = "Label") -> DataFrame:
    """df with ``label``; rows whose label is not in the map go."""
    items = [x for k, v in (labels or vocab.LABELS).items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn("label", F.create_map(*items)[F.col(column)]).filter(F.col("label").isNotNull())


def keyed_order(key: str, seed: int = SEED) -> list[Column]:
    """A random order that depends on seed and key alone."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def keyed_rank(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """df with ``_n``, each row's rank within its class in keyed order, and ``_all``, the rows of the class.

    Hashes fall into BUCKETS by their first digits; a rank is what lower buckets hold plus the rank within the bucket.
    So no class is sorted in one task: what is gathered by class is a count for each bucket.
    """
    rows = df.withColumn("_h", keyed_order(key, seed)[0]).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_k"))
    by_label = Window.partitionBy("_l")
    before = counts.select("_l", "_c", F.sum("_k").over(by_label.orderBy("_c")).alias("_to"), "_k", F.sum("_k").over(by_label).alias("_all"))
    joined = rows.join(before, (rows[label].eqNullSafe(before["_l"])) & (rows["_b"] == before["_c"]))
    within = F.row_number().over(Window.partitionBy("_l", "_c").orderBy("_h", key))
    return joined.select(*df.columns, (F.col("_to") - F.col("_k") + within).alias("_n"), "_all")


def balance(df: DataFrame, label: str, key: str, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """As many rows of each class as the smallest has (or cap, if that is less), drawn without replacement."""
    n = df.groupBy(label).count().agg(F.min("count").alias("n")).first().n or 0
    n = n if cap is None else min(n, cap)
    return keyed_rank(df, label, key, seed).filter(F.col("_n") <= n).select(*df.columns)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """df with ``split``: of each class, the first share in keyed order is test, the rest train."""
    ranked = keyed_rank(df, label, key, seed)
    return ranked.select(*df.columns, F.when(F.col("_n") <= F.floor(F.col("_all") * share + 0.5), "test").otherwise("train").alias("split"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """label, prediction, n for every pair of classes, zeros included. classes is a short list."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"label {dict(df.dtypes)[label]}, prediction {dict(df.dtypes)[label]}")
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weighted_prf(confusion: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 of a confusion matrix, weighted by the classes' true counts; undefined ones are 0."""
    # Each cell counts for its label and for its prediction, so the matrix is made once.
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), hit.alias("hit"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("predicted")),
    )
    classes = confusion.select(F.explode(sides).alias("s")).groupBy("s.c").agg(*[F.sum(f"s.{x}").alias(x) for x in ("support", "hit", "predicted")])
    per = classes.select(
        "support", "hit", F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0).alias("p"), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0).alias("r")
    )
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    weighted = lambda c: F.sum(F.col("support") * F.col(c)) / F.sum("support")
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"))


def per_class_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def argmax_label(probabilities: Column) -> Column:
    """The place (from 0) of the greatest of an array, the first of equals."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def bar(share: Column, width: int = 20) -> Column:
    """A text bar: full blocks for the share, light ones for the rest."""
    n = F.floor(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))
