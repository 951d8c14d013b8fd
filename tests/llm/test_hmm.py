import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import hmm as h

from . import brute


SYMBOLS = h.WORDS + h.CLASSES + 1


def small(rng, k=3):
    return h.Hmm.of_counts(rng.random(k), rng.random((k, k)), rng.random((SYMBOLS, k)) ** 8)


def test_forward_and_counts_match_enumeration():
    rng = np.random.default_rng(1)
    model = small(rng)
    seqs = [rng.integers(0, SYMBOLS, n) for n in (1, 2, 5, 5, 3)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((SYMBOLS, 3))
    for s, got in zip(seqs, h.forward(model, seqs), strict=True):
        paths = {p: model.start[p[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(model.emit[x, q] for x, q in zip(s, p, strict=True)) for p in itertools.product(range(3), repeat=len(s))}
        total = sum(paths.values())
        assert got == pytest.approx(math.log(total))
        for p, v in paths.items():
            start[p[0]] += v / total
            for a, b in itertools.pairwise(p):
                move[a, b] += v / total
            for x, q in zip(s, p, strict=True):
                emit[x, q] += v / total
    for want, got in zip((start, move, emit), h.expected(model, seqs), strict=True):
        assert np.allclose(want, got)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [(rng.integers(0, 50, 40) + 50 * (k % 2)) for k in range(60)]
    model = small(rng, 4)
    before = h.forward(model, seqs).sum()
    for _ in range(3):
        model = h.Hmm.of_counts(*h.expected(model, seqs))
        now = h.forward(model, seqs).sum()
        assert now > before
        before = now


def test_base_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(h, "KNOWN", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs} | {9000: None, 9001: "", 9002: "Zebra zebra unseenword", 9003: "x " * 9000}
    spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in h.op7_hmm_score(spark, str(tmp_path)).collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    tokens = {i: [*brute.WORD.findall(brute.lower(t or "")), None] for i, t in texts.items()}
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(own), sum(c[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_words_sum_to_one(spark):
    """The probabilities of all texts of one word, seen or not, and of the empty text's end add up to the first symbols' whole."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[: 1 + i % 40]), True) for i in range(80)], "doc_id long, text string, train boolean")
    got = h.score(docs, states=2, rounds=1).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    empty = docs.limit(0)
    assert h.score(empty).count() == 0
    none = h.score(docs.selectExpr("doc_id", "text", "false as train")).collect()
    assert len(none) == 80 and all(math.isfinite(r.score) and r.n_known == 0 for r in none)


def test_states_start_from_all_documents(spark):
    """Without a Baum-Welch round the model is the start alone; it knows every document's own word."""
    docs = spark.createDataFrame([(i, f"own{i} " * 20, True) for i in range(3000)], "doc_id long, text string, train boolean")
    got = h.score(docs, states=2, rounds=0).collect()
    assert len(got) == 3000 and all(r.score > r.base_score - 10 for r in got)


def test_cluster_counts_match_a_plain_sum(monkeypatch):
    monkeypatch.setattr(h, "BATCH_TOKENS", 7)
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 9, n) for n in (1, 12, 5, 5, 3)]
    emit, share = np.log(rng.random((9, 3))), np.log(rng.random(3))
    docs, counts = np.zeros(3), np.zeros((9, 3))
    for s in seqs:
        k = int((emit[s].sum(0) + share).argmax())
        docs[k] += 1
        np.add.at(counts[:, k], s, 1)
    got = h.cluster_counts(emit, share, seqs)
    assert np.array_equal(got[0], docs) and np.array_equal(got[1], counts)
