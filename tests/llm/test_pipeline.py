from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from weftline.llm import common, packing

from . import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(common.save(stage(spark, steps[-1], sf), "test"))
    raw, good, once, clean, mixed, packed = steps
    for df in steps[1:-1]:
        assert df.columns == docs.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    short = {r.doc_id for r in raw.collect() if len(brute.WORD.findall(r.text)) < 50}
    assert not short & set(texts)
    missed = [i for i, r in labels.items() if r.quality == 1 and i not in short and i not in texts]
    assert len(missed) <= 0.05 * len(labels)
    sets = {i: brute.shingles(t, 5) for i, t in texts.items()}
    want = brute.roots(sets, brute.similar(sets, 80))
    assert sorted(r.doc_id for r in once.collect()) == sorted({r for r in want.values()})
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (once, clean))
    assert before.keys() == after.keys() and all(a == before[i] or "[SECRET]" in a for i, a in after.items())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and copies.keys() <= after.keys()
    tok = packing.encoder(packing.tokenizer_path())
    total = sum(n * (len(tok.encode([after[i]])[0]) // 2 + 1) for i, n in copies.items())
    assert packed.agg(F.sum("length")).first()[0] == total


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"{'alpha beta gamma delta ' * 30}{i % 5}", "en", None, None) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    # five ids with four rows each; their sets of five shingles share four of six, so none are linked
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3, 4]
    same = docs.withColumn("text", F.lit("alpha beta gamma"))
    assert [r.doc_id for r in cp.near_duplicates(spark, same, "").collect()] == [0]
    assert cp.mix_sources(spark, docs.limit(0), "").count() == 0
