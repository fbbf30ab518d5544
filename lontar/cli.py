"""Command line: ``python -m lontar.cli extract|links|train|classify``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ml, vocab
from .operators import corpus, frontier, language
from .plans import extract
from .sources import storage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lontar")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="pages (parquet: page_id, url, html) to accepted and rejected sentences")
    e.add_argument("--pages", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--languages", nargs="+", default=list(vocab.TARGET_LANGUAGES))
    link = sub.add_parser("links", help="pages to the links within their domains")
    link.add_argument("--pages", required=True)
    link.add_argument("--output", required=True)
    t = sub.add_parser("train", help="a corpus CSV to a classifier")
    t.add_argument("--corpus", required=True)
    t.add_argument("--model", required=True)
    t.add_argument("--cap", type=int, default=2_000_000 // 3)
    c = sub.add_parser("classify", help="texts to labels")
    c.add_argument("--model", required=True)
    c.add_argument("--file")
    c.add_argument("--text", action="append", default=[])
    c.add_argument("--output")
    c.add_argument("--probs", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lontar").getOrCreate()
    if args.command == "links":
        frontier.extract_links(spark.read.parquet(args.pages)).write.mode("overwrite").parquet(args.output)
    elif args.command == "extract":
        pages = spark.read.parquet(args.pages)
        rows = extract.extract_sentences(extract.page_texts(pages), language.detect_language(F.col("sentence")), tuple(args.languages))
        records = rows.withColumn("religion", F.lit("Web")).withColumn("source", F.lit("")).withColumn("region", F.lit("Unknown"))
        storage.write_corpus(corpus.map_output(records.filter("is_target")), f"{args.output}/sentences")
        storage.write_corpus(corpus.map_rejected(records.filter("NOT is_target")), f"{args.output}/rejected")
    elif args.command == "train":
        rows = corpus.label_ids(storage.read_corpus(spark, args.corpus)).withColumn("key", F.md5(F.concat_ws("\u0001", "Link", "Sentence_Unit")))
        parts = corpus.stratified_split(corpus.balance(rows, "label", "key", args.cap), "label", "key")
        model = ml.train(parts.filter("split = 'train'"))
        names = F.create_map(*[x for k in vocab.LABELS for x in (F.lit(k), F.lit(vocab.LABELS[k]))])
        scored = ml.classify(model, parts.filter("split = 'test'"), vocab.LABELS).withColumn("predicted", names[F.col("predicted")])
        figures = ml.evaluate(scored, "label", "predicted", list(vocab.LABELS.values())).first().asDict()
        ml.save(model, args.model, vocab.LABELS, {"max_length": ml.MAX_TOKENS, "label_map": vocab.LABELS, **figures})
        print(json.dumps(figures))
    else:
        texts = storage.read_texts(spark, args.file) if args.file else spark.createDataFrame([(t,) for t in args.text], "value string")
        labels = json.loads(spark.read.text(f"{args.model}/label_map").first()[0])
        found = ml.classify(PipelineModel.load(f"{args.model}/model"), texts.withColumnRenamed("value", "Sentence_Unit"), labels)
        found = found.select(F.col("predicted").alias("label"), "confidence", F.col("Sentence_Unit").alias("text"), *(["probabilities"] if args.probs else []))
        if args.output:
            storage.write_json(found, args.output)
        for row in found.limit(10).collect():
            print(f"{row.label}\t{row.confidence:.4f}\t{row.text}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
