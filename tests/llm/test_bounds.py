"""What training takes to the driver is bounded, whatever the columns hold."""

from corpusloom.llm import toxicity
from corpusloom.llm.common import sample_by


def test_many_languages(spark):
    df = spark.range(20000).selectExpr("concat('l', id % 5000) AS lang", "concat('text ', id) AS text")
    got = sample_by(df, "lang", 1500, most=10_000)
    assert got.groupBy("lang").count().agg({"count": "max"}).first()[0] == 2
    assert 9_000 < got.count() <= 10_000
    more = df.union(spark.range(50).selectExpr("'often' AS lang", "concat('other ', id) AS text")).union(spark.range(9).selectExpr("CAST(NULL AS STRING)", "'none'"))
    few = sample_by(more, "lang", 1500, most=100)
    assert few.select("lang").distinct().count() <= 100 and few.filter("lang = 'often'").count() == 1
    assert not few.filter("lang IS NULL").count()


def test_many_texts_of_one_id(spark, monkeypatch):
    docs = spark.range(10000).selectExpr("id % 2 AS doc_id", "concat('some words ', id) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, share: seen.extend(rows) or toxicity.Model())
    toxicity.fit(docs, labels)
    assert sorted(k for _, k in seen) == [0, 1]
