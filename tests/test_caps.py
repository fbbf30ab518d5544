"""Queries with the reference's caps, and a corpus with all labels."""

import pytest
from pyspark.sql import functions as F

from lontar.plans.queries import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(i, f"text {i}", lang, "s", 6) for i, lang in enumerate(["en", "fr", "de", "es"] * 30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"https://example.com/{i}", "") for i in range(9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_whole(spark, folder):
    assert QUERIES["domain_cap"](spark, folder).count() == 9
    assert QUERIES["balance_capped"](spark, folder).count() == 120
    latest = QUERIES["scan_combined_latest"](spark, folder)
    assert {(r.Label, r["count"]) for r in latest.groupBy("Label").count().collect()} == {("En", 30), ("Fr", 30), ("De", 30), ("Es", 30)}
    assert latest.filter(F.col("Link") == "old").count() == 0
