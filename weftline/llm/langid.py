"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import ready, remainder, save, sent, table, text_slices

#: Buckets of the hashed n-grams of 1 to 3 bytes.
SIZE_BITS = 12
SIZE = 1 << SIZE_BITS
#: About so many labelled documents of a language fit its centroids; document frequencies come from all of them.
FIT_DOCS, CENTROIDS = 500, 4
UNKNOWN = "und"

# letters as lower case, every other ASCII byte as a space
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = np.zeros(256, np.uint8)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = 1


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte n-grams of each text, case and marks between words folded: texts x SIZE."""
    n = len(offsets) - 1
    b = _FOLD[data]
    if len(b) > 1:  # capital letters of Latin-1 have two bytes
        b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)] += 32
    cells = np.zeros(n * SIZE, np.int64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    code = np.zeros(len(b), np.uint32)
    for k in range(3):
        m = len(b) - k
        if m <= 0:
            break
        code = code[:m] | (b[k:].astype(np.uint32) << np.uint32(8 * k))
        inside = text[:m] == text[k:]
        bucket = ((code + np.uint32(k + 1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SIZE_BITS)
        cells += np.bincount((text[:m] * SIZE + bucket)[inside], minlength=n * SIZE)
    return cells.reshape(n, SIZE)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts).astype(np.float32) * idf)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray  # of each centroid
    reject: np.ndarray  # cosine below which a text is too far from each centroid

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        near = _vectors(term_counts(data, offsets), self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(np.float64)
        return self.language[best].tolist(), score, score < self.reject[best]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts."""
    start = [_unit(x.mean(0, keepdims=True))[0]]
    while len(start) < min(k, len(x)):
        start.append(x[np.argmin((x @ np.array(start).T).max(1))])
    c = np.array(start)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = _unit(c)
    return c


def _has_letter(raw: bytes) -> bool:
    return any(ch.isalpha() for ch in raw.decode("utf-8", "replace"))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, centroids: int = CENTROIDS) -> Model | None:
    """Learn from the rows of docs with a lang and a text; None if there are none.

    Document frequencies are summed over all rows. Centroids come from about fit_docs rows a
    language, those whose id hashes low, of which the driver gets the term counts.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = save(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_docs = sizes.agg(F.sum("n")).first()[0]
    if not n_docs:
        return None

    def frequencies(batches):
        total = np.zeros(SIZE, np.int64)
        for b in batches:
            for _, _, data, offs in text_slices(b.column("text"), rows=256):
                total += (term_counts(data, offs) > 0).sum(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    df = np.zeros(SIZE)
    for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def counts(batches):
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column("text"), rows=256):
                x = np.minimum(term_counts(data, offs), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    scale = 1 << 20
    share = sizes.select("lang", F.least(F.lit(scale), F.ceil(F.lit(scale * fit_docs) / F.col("n"))).alias("share"))
    picked = docs.join(sent(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(scale)) < F.col("share")).select("doc_id", "lang", "text").mapInArrow(counts, "doc_id long, lang string, x binary")
    # a repeated id counts once, so a key that fills a large share of the rows doesn't reach the driver in bulk
    got = picked.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).toPandas().sort_values(["lang", "doc_id"], na_position="first")
    names, parts, floors = [], [], []
    for lang, rows in got.groupby("lang"):
        x = _vectors(np.stack([np.frombuffer(r, "<u2") for r in rows["x"]]).astype(np.float32), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            continue
        c = cluster(x, centroids)
        near = x @ c.T
        own = near.argmax(1)
        for j in range(len(c)):
            mine = near[own == j, j]
            names.append(lang)
            parts.append(c[j])
            floors.append(max(0.0, mine.mean() - 4 * mine.std()) if len(mine) else 0.0)
    return Model(idf, np.array(parts), np.array(names), np.array(floors)) if parts else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row from its whole text alone.

    lang_pred is the language of the nearest centroid and score the cosine. A text that is null or has
    no letter, or any text without a model, is `und` with score 0 and rejected. rejected marks texts
    farther from the nearest centroid than its own documents lie; the nearest language is still
    given. Equal texts get equal results; other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, data, offs in text_slices(b.column("text"), rows=256):
                letters = tv.sums(_LETTER, data, offs) > 0
                for i in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[i] = _has_letter(data[offs[i] : offs[i + 1]].tobytes())
                if model is None:
                    letters[:] = False
                lang, score, far = model.predict(data, offs) if model is not None else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo), letters)
                lang = [x if ok else UNKNOWN for x, ok in zip(lang, letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
