import zlib

from pyspark.sql import functions as F

from weftline.llm import sharding as s


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (5000, "", "en"), (5001, "ä", None), (5001, "ä", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("weight", F.lit("clash"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = s.shard_documents(rows).toPandas()
    assert len(got) == len(docs.collect()) + 4 and set(got["shard"]) == set(range(16)) and got["grown_shard"].isna().all()
    for r in got[got["doc_id"].notna()].itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    size = got.groupby("shard")["size"].sum()
    assert size.max() < 1.1 * size.min()
    assert s.shard_documents(rows.limit(0)).count() == 0


def test_huge_group_is_cut(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    got = s.shard_documents(rows, shards=5).groupBy("shard").agg(F.sum("size").alias("w"), F.max("slot").alias("top"), F.count("*").alias("n")).collect()
    assert len(got) == 5 and max(r.w for r in got) < 1.03 * min(r.w for r in got) and all(r.top == r.n - 1 for r in got)
    assert s.shard_documents(rows, target_bytes=10_000).select("shard").distinct().count() == 4
    one = s.shard_documents(rows.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_no_python(spark):
    plan = s.op3_kd_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
