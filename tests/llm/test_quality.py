import re
from collections import Counter

import numpy as np
import pyarrow as pa

from weftline.llm import quality as q

from . import brute as plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


REGULAR = [x for n in (1024, 2048, 4096, 8192) for a, b in [plain.thue_morse(n)] for x in (f"{a} x y {b} x y", f"{a} x y {a} x y")]
TEXTS = [*REGULAR, None, "", " \n\t ", "a", "a b c a b c", "x " * 200, "é ß|é\né ß|é\n\n \n", "one\x1ctwo three\x0bfour", "w" * 300_000 + " tail", "# * $ % & | < >", "a b a b a b a", "line one\nline one \nline one\n"]


def test_counts_match_brute_force():
    counts, feats = q.metrics(pa.array(TEXTS))
    assert feats.shape == (len(TEXTS), len(q.FEATURES)) and np.isfinite(feats).all()
    for i, t in enumerate(TEXTS):
        assert {k: int(v[i]) for k, v in counts.items()} == brute(t), t and t[:40]


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(3000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    trees = q.fit_trees(x, y, np.array([-1, 0, 0]))
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.9
    line = np.tile(rng.random(3), (200, 1))
    line[:, 0] = np.linspace(-1, 2, 200)
    assert (np.diff(trees.score(line)) <= 1e-12).all()


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(1000, "", 8), (None, "x y", 9)], "doc_id long, text string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = q.op1_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows}
    assert by[TEXTS.index("x " * 200)].base_failed and not by[TEXTS.index("x " * 200)].kept and by[TEXTS.index(None)].n_words == 0 and not by[TEXTS.index(None)].kept
    assert q.score_documents(docs.limit(0), None).count() == 0
    kept = q.keep_good(docs, None)
    assert kept.columns == docs.columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.score_documents(docs, q.fit(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    right = (got["score"] >= 0.5) == (got["quality"] > 0)
    assert right.mean() > 0.9
    assert (got["score"] >= 0.5)[got["quality"] > 0].mean() > 0.96
