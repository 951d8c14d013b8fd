import random

import numpy as np

from weftline.llm import common
from weftline.llm import minhash as m

from . import brute


def check(got, texts):
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    want = brute.roots(sets, brute.similar(sets))
    by = {r.doc_id: r for r in got.collect()}
    assert {i: r.n_shingles for i, r in by.items() if i is not None} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in by.items() if i is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for i, r in by.items() if i is not None)
    return by


def test_edges(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(60)}" for _ in range(200)]
    texts = {1: None, 2: "", 3: " \n", 4: "A b", 5: "a  B", 6: "a", 7: "a b c", 8: "A\tB C", 9: "x " * 5000, 10: "x " * 90}
    for i in range(40):  # a chain: each differs a little from the last, so the ends are far apart
        base[rng.randrange(200)] = f"new{i}"
        texts[20 + i] = " ".join(base)
    for i in range(30):  # one group of near copies around one text
        own = [f"v{k}" for k in range(150)]
        own[rng.randrange(150)] = f"z{i}"
        texts[100 + i] = " ".join(own)
    rows = [(i, t, -1) for i, t in texts.items()] + [(None, "a b c", 0), (7, "a b c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = m.near_duplicates(df)
    by = check(got, texts)
    assert got.count() == len(rows) and by[None].kept and by[None].component_id is None
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(m.op6_minhash_dedup(spark, "/root/testdata/sf0.001"), {r.doc_id: r.text for r in docs.collect()})


def test_shuffle_way(spark, monkeypatch):
    monkeypatch.setattr(common, "SEND_ROWS", -1)
    texts = {i: f"one two three four five six {i // 3} " * 3 for i in range(30)}
    check(m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), texts)


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 150, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        off = int(np.bitwise_count((m.parity(a) ^ m.parity(b)).view(np.uint64)).sum())
        assert off <= len(set(a.tolist()) ^ set(b.tolist()))


def test_bands_follow_from_the_similarity():
    assert (m.Plan.of(85, 3).bands, m.Plan.of(85, 3).rows, m.Plan.of(85, 3).off) == (25, 5, 36)
    for percent in (60, 80, 85, 95, 100):
        p = m.Plan.of(percent, 5)
        assert p.bands * p.rows <= m.HASHES and (1 - (percent / 100) ** p.rows) ** p.bands <= m.BAND_MISS


def test_words_of_regular_letters(spark):
    texts = {}
    for k, n in enumerate((1024, 2048, 4096, 8192)):
        a, b = brute.thue_morse(n)
        texts |= {10 * k: f"{a} x y z {a}", 10 * k + 1: f"{b} x y z {b}"}
    check(m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), texts)


def test_one_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, one, "x"), (1, two, "y"), (1, two, "y"), (2, two + " end", "z"), (3, one, "w"), (None, one, "n"), (None, one, "n"), (4, "", "e"), (4, "", "e"), (5, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({"_h": m.F.lit(1), "_TH": m.F.lit(2)})
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in m.near_duplicates(docs).collect())
    assert got == sorted([(1, 98, 1, True), (1, 98, 1, True), (1, 98, 1, True), (2, 99, 1, False), (3, 98, 1, False), (0, 98, 0, True), (0, 98, 0, True), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 5, True)])
    kept = m.once(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2], r._id) for r in kept.collect()) == sorted([(1, "a0", "x"), (1, "b0", "y"), (0, "a0", "n"), (0, "a0", "n"), (4, "", "e"), (5, "", "f")])
    assert m.once(docs.limit(0)).count() == 0


def test_strays_meet_all_parts_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(m, "MEMBERS", 5)
    rng = random.Random(9)
    texts = {}
    for i in range(120):  # one crowded neighbourhood with chains in it
        own = [f"v{k}" for k in range(120)]
        for _ in range(rng.randrange(9)):
            own[rng.randrange(120)] = f"z{rng.randrange(40)}"
        texts[i] = " ".join(own)
    check(m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), texts)
