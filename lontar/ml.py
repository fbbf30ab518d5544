"""The text classifier: trained on labelled sentences, scored in batches, judged by weighted figures."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus

MAX_TOKENS, FEATURES, ITERATIONS = 128, 1 << 14, 20


def train(rows: DataFrame, text: str = "Sentence_Unit", label: str = "label", iterations: int = ITERATIONS) -> PipelineModel:
    """A multinomial regression over hashed, weighted words of the first MAX_TOKENS tokens."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_all", pattern=r"[^\p{L}\p{N}]+"),
        SQLTransformer(statement=f"SELECT *, slice(_all, 1, {MAX_TOKENS}) AS _tokens FROM __THIS__"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=FEATURES),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(rows.select(F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("double").alias(label)))


def classify(model: PipelineModel, rows: DataFrame, labels: dict[str, int], text: str = "Sentence_Unit") -> DataFrame:
    """rows with label name, confidence and probabilities by name."""
    names = F.array(*[F.lit(n) for n, _ in sorted(labels.items(), key=lambda x: x[1])])
    scored = model.transform(rows.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    p = vector_to_array("probability")
    kept = [F.col(c) for c in rows.columns]
    return scored.select(*kept, F.get(names, corpus.argmax_label(p)).alias("predicted"), F.array_max(p).alias("confidence"), F.map_from_arrays(names, p).alias("probabilities"))


def evaluate(predictions: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    return corpus.weighted_prf(corpus.confusion_matrix(predictions, label, prediction, classes))


def predict(model: PipelineModel, texts: list[str], labels: dict[str, int], text: str = "Sentence_Unit") -> list[dict]:
    """label, confidence, text and probabilities of a few texts, in their order."""
    spark = SparkSession.active()
    rows = spark.createDataFrame(list(enumerate(texts)), f"_at long, {text} string")
    found = classify(model, rows, labels, text).orderBy("_at").collect()
    return [{"label": r.predicted, "confidence": r.confidence, "text": r[text], "probabilities": r.probabilities} for r in found]


def load(path: str) -> tuple[PipelineModel, dict[str, int]]:
    """A saved model and its label map."""
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/label_map").first()[0])


def save(model: PipelineModel, path: str, labels: dict[str, int], info: dict) -> None:
    """The model, its label map and how it was trained."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    for name, value in (("label_map", labels), ("training_info", info)):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
