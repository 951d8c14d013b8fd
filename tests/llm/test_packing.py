import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from weftline.llm import packing as p
from weftline.llm.encoder import Encoder

TEXTS = [None, "", " ", "a", "two  spaces and\ttabs \n\n end ", "line\nline two\n\nthree", "don't 12 34's é ü ñ  x", "w" * 5000, "word " * 3000, "日本語 のテキスト <|endoftext|> z", "\x1c a\x1cb ", "a\n b", "x\r\ny  z"]


def plain(texts):
    tok = Tokenizer.from_file(p.tokenizer_path())
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizers_library(spark):
    texts = TEXTS + ["a" * 70_000, " " * 70_000 + "x", "\n" * 30_000, "word " * 30_000] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    enc = Encoder(p.tokenizer_path())
    assert enc.engine is not None
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == plain(texts)
    enc.engine = None
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(TEXTS)] == plain(TEXTS)


def test_assign_fills_sequences():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 1024, 500)
    placed = p.assign(lengths, 1024)
    used = pd.DataFrame(placed, columns=["item", "start", "n", "seq", "offset"])
    assert used.groupby("item")["n"].sum().to_dict() == {i: n for i, n in enumerate(lengths.tolist()) if n}
    fill = used.groupby("seq")["n"].sum()
    assert fill.max() <= 1024 and len(fill) == -(-lengths.sum() // 1024)
    assert p.assign(np.array([], np.int64), 8) == []


def test_pieces_hold_every_id_once(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "null id", 1)], "doc_id long, text string, length int")
    got = p.pack(docs, p.tokenizer_path(), pool_docs=5).toPandas()
    ids = dict(enumerate(plain(TEXTS)))
    for doc, rows in got[got["doc_id"].notna()].groupby("doc_id"):
        whole, at = [*ids[doc], p.END_ID], 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(whole)
            at += r.length
            assert zlib.crc32(np.array(whole[r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(whole)
    assert got["doc_id"].nunique() == len(TEXTS) and got["doc_id"].isna().sum() == 1
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id")["length"].cumsum() - order["length"] == order["offset"]).all()
    assert order.groupby("sequence_id")["length"].sum().max() <= 1024
    assert p.pack(docs.limit(0), p.tokenizer_path()).count() == 0
