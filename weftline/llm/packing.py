"""Cost-balanced packing of documents into token sequences of fixed capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table
from .encoder import encoder, id_type, vocabulary_size

#: Documents that are packed together; each such pool leaves less than one sequence of padding.
POOL_DOCS = 4096
END_ID = 0


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Place items of at most `capacity` tokens: (item, start in it, length, sequence, offset).

    A piece costs linear * n + quadratic * n**2 (attention). Items come in descending length and go
    to the sequence of least cost that still has room for them; where none has, the item is cut to
    fill the cheapest open one. As few sequences are used as the tokens need.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    out = []
    work = [(int(i), 0, int(lengths[i])) for i in np.argsort(-lengths, kind="stable") if lengths[i]]
    for item, start, left in work:
        while left:
            open_ = room >= left
            if not open_.any():
                open_ = room > 0
            k = int(np.argmin(np.where(open_, cost, np.inf)))
            take = min(left, int(room[k]))
            out.append((item, start, take, k, capacity - int(room[k])))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return out


def _pack_pool(key, pdf: pd.DataFrame, capacity: int, dtype: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "doc_tokens", "rest"], kind="stable").reset_index(drop=True)
    rests = [np.frombuffer(x, dtype) for x in pdf["rest"]]
    rows, sequence = [], int(key[0]) << 32
    ids, tokens = pdf["doc_id"].tolist(), pdf["doc_tokens"].tolist()
    for i, crcs in enumerate(pdf["full_crcs"]):
        for k, crc in enumerate(crcs):
            rows.append((ids[i], k * capacity, capacity, int(crc), tokens[i], sequence, 0))
            sequence += 1
    for i, start, n, k, offset in assign(np.array([len(r) for r in rests], np.int64), capacity):
        crc = zlib.crc32(rests[i][start : start + n].astype("<u4").tobytes())
        rows.append((ids[i], len(pdf["full_crcs"][i]) * capacity + start, n, crc, tokens[i], sequence + k, offset))
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, pool_docs: int = POOL_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids.

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Whole multiples of
    the capacity fill sequences of their own; what remains is packed by cost in pools that a hash of
    doc_id and text makes. Each text is encoded once, and only
    remainders travel. An empty table gives no rows; other columns are ignored.
    """
    ready(docs.sparkSession)
    pools = max(1, -(-docs.count() // pool_docs))

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([END_ID], enc.dtype).tobytes()
        for b in batches:
            texts = b.column("text")
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows = ([], [], [])
                for ids in enc.encode(texts.slice(lo, 256).to_pylist()):
                    a = np.frombuffer(ids + end, enc.dtype)
                    full = len(a) // capacity
                    rows[0].append(len(a))
                    rows[1].append([zlib.crc32(a[k * capacity : (k + 1) * capacity].astype("<u4").tobytes()) for k in range(full)])
                    rows[2].append(a[full * capacity :].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("pool"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.binary())], names=["doc_id", "pool", "doc_tokens", "full_crcs", "rest"])

    dtype = id_type(vocabulary_size(tokenizer)).str
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(pools)).alias("pool"), "text").mapInArrow(run, "doc_id long, pool long, doc_tokens long, full_crcs array<long>, rest binary")
    return cut.groupBy("pool").applyInPandas(lambda key, pdf: _pack_pool(key, pdf, capacity, dtype), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
