from lontar import cli, vocab
from lontar.sources import storage


def test_extract_train_classify(spark, tmp_path, capsys):
    page = "<p>{} berjalan bersama menuju kota lama setiap pagi dengan keluarga dan untuk itu.</p><a href='/x'>x</a>"
    pages = [(i, f"https://a.id/{i}", page.format(n)) for i, n in enumerate(("Mereka", "Mereka", "Semua"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    assert cli.main(["extract", "--pages", f"{tmp_path}/pages", "--output", f"{tmp_path}/out", "--languages", "id"], spark) == 0
    kept = storage.read_corpus(spark, f"{tmp_path}/out/sentences").collect()
    assert sorted(x.Sentence_Unit.split()[0] for x in kept) == ["Mereka", "Semua"]
    cli.main(["links", "--pages", f"{tmp_path}/pages", "--output", f"{tmp_path}/links"], spark)
    assert {x.link for x in spark.read.parquet(f"{tmp_path}/links").collect()} == {"https://a.id/x"}
    rows = [(label, "", "", "", "", f"kata {label.lower()} nomor {i}", f"u{i}") for label in vocab.LABELS for i in range(30)]
    storage.write_corpus(spark.createDataFrame(rows, storage.CORPUS_SCHEMA), f"{tmp_path}/corpus")
    cli.main(["train", "--corpus", f"{tmp_path}/corpus", "--model", f"{tmp_path}/model"], spark)
    assert '"accuracy": 1.0' in capsys.readouterr().out
    cli.main(["classify", "--model", f"{tmp_path}/model", "--text", "kata catholic", "--probs", "--output", f"{tmp_path}/pred"], spark)
    assert capsys.readouterr().out.startswith("Catholic\t")
    assert spark.read.json(f"{tmp_path}/pred").first().label == "Catholic"
