"""A lang column with more values than any fixed number of languages."""

from pyspark.sql import functions as F

from quarry.llm import langid


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i % 230) * 40, f"l{i % 230:03d}") for i in range(460)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df, F.lit(True))
    assert net.langs == [f"l{i:03d}" for i in range(230)]


def test_a_small_sample_has_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_DOCS", 30)
    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, windows, target: seen.extend(target))
    rows = [(i, f"text {i}", f"l{i % 40:02d}") for i in range(1200)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(seen) == set(range(40)) and len(seen) < 200
