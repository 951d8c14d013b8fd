from pyspark.sql import functions as F

from weftline.llm import langid as g


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = g.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    own = got[got["held_out"]]
    assert len(got) == docs.count() and (own["lang"] == own["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = g.fit(docs)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 !? \n", 0.5), (4, "é", 0.5), (5, "the of and " * 60_000, 0.5), (5, "Ω", 0.5), (None, "der und die", 0.5)], "doc_id long, text string, score double")
    got = [tuple(r) for r in g.identify(odd, model).collect()]
    assert [r[1] for r in got[:3]] == ["und"] * 3 and all(r[2] == 0 and r[3] for r in got[:3])
    assert all(r[1] in {"en", "de", "fr", "es"} for r in got[3:]) and got[4][1] == "en"
    assert g.fit(docs.limit(0)) is None and {r.lang_pred for r in g.identify(odd, None).collect()} == {"und"}
    assert g.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert g.identify(odd.limit(0), model).count() == 0


def test_far_text_is_rejected(spark):
    model = g.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')"))
    got = g.identify(spark.createDataFrame([(1, "ъыэжщ цчшю йфвб " * 30)], "doc_id long, text string"), model).collect()
    assert got[0].rejected
