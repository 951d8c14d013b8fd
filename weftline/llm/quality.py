"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows, flattened into numpy node arrays and
applied to whole batches. Features named in MONOTONE can only push the score one way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import ready, table, text_slices

#: Labelled rows that a fit reads at most, those with the smallest hash of their id.
FIT_ROWS = 6000
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "shouts", "words_per_line", "bars", "stops", "non_ascii")
#: -1: a larger value never raises the quality score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SYMBOLS, _UPPER, _DIGITS = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_SHOUTS, _BARS, _STOPS, _LINES = _flags(b"!?"), _flags(b"|"), _flags(b".,;:"), _flags(b"\n")
_HEADS = (~tv.SPACE).astype(np.uint8)  # bytes that begin a code point of a word
_HEADS[128:192] = 0
_WIDE = _flags(bytes(range(192, 256)))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)) if len(lines) > 1 else 0


def _repeat_words(w: tv.Words) -> np.ndarray:
    """Words of each text inside a 3-word window that the text holds twice or more."""
    n = len(w.counts)
    keys, at = tv.windows(w)
    if not len(keys):
        return np.zeros(n, np.int64)
    text = w.text_of
    keys = tv.mix(keys + tv.mix(text[at].astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    where = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = at[twice[where] == keys]
    inside = np.zeros(len(text), bool)
    for k in range(3):
        inside[hit + k] = True
    return np.bincount(text[inside], minlength=n)


def _distinct(w: tv.Words) -> np.ndarray:
    """Distinct words of each text."""
    text = w.text_of
    _, first = np.unique(tv.mix(w.hashes + tv.mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(text[first], minlength=len(w.counts))


def metrics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text, and the features of the trees in the order of FEATURES."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    parts: list[list[np.ndarray]] = []
    feats: list[np.ndarray] = []
    for lo, hi, data, offs in text_slices(column):
        w = tv.words(data, offs, lower=False)
        s = lambda t: tv.sums(t, data, offs)  # noqa: E731, B023
        raw = data.tobytes()
        dup = np.fromiter((_dup_lines(raw[offs[i] : offs[i + 1]]) for i in range(hi - lo)), np.int64, hi - lo)
        row = [w.counts, s(_HEADS), s(_SYMBOLS), dup, _repeat_words(w)]
        parts.append(row)
        n, chars, lines = np.maximum(row[0], 1), np.maximum(row[1], 1), s(_LINES) + 1
        feats.append(np.stack([row[0], row[1] / n, row[2] / chars, dup / lines, row[4] / n, _distinct(w) / n, s(_UPPER) / chars, s(_DIGITS) / chars, s(_SHOUTS) / chars, n / lines, s(_BARS) / chars, s(_STOPS) / chars, s(_WIDE) / chars], 1))
    if not parts:
        return {k: np.zeros(0, np.int64) for k in names}, np.zeros((0, len(FEATURES)))
    return {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(names)}, np.concatenate(feats)


@dataclass
class Trees:
    """Node arrays of all trees, one row a tree; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probability of good quality for each row."""
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))
        for lo in range(0, len(x), block):
            part = x[lo : lo + block]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(tree)), np.int64)
            for _ in range(self.depth):
                less = part[rows, self.feature[tree, at]] <= self.threshold[tree, at]
                at = np.where(less, self.left[tree, at], self.right[tree, at])
            out[lo : lo + block] = 1 / (1 + np.exp(-np.clip(self.base + self.value[tree, at].sum(1), -40, 40)))
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, damp: float = 1.0) -> Trees:
    """Boosted regression trees of the logistic loss. monotone: -1, 0 or 1 for each feature."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    out = Trees(np.zeros(shape, np.int64), np.zeros(shape), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), base, depth)
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p) + 1e-9
        work = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            k, rows, level, low, high = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b, n = code[rows, j], len(c) + 1
                    gl, hl, cl = (np.cumsum(np.bincount(b, v, n))[:-1] for v in (grad[rows], hess[rows], None))
                    gain = gl**2 / (hl + damp) + (g - gl) ** 2 / (h - hl + damp) - g**2 / (h + damp)
                    vl, vr = np.clip(gl / (hl + damp), low, high), np.clip((g - gl) / (h - hl + damp), low, high)
                    ok = (cl >= least) & (len(rows) - cl >= least) & (monotone[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    i = int(np.argmax(gain))
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, i, vl[i], vr[i])
            if best is None:
                v = float(np.clip(g / (h + damp), low, high)) * rate
                out.value[t, k] = v
                raw[rows] += v
                continue
            _, j, i, vl, vr = best
            out.feature[t, k], out.threshold[t, k] = j, cuts[j][i]
            out.left[t, k], out.right[t, k] = 2 * k + 1, 2 * k + 2
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            less = code[rows, j] <= i
            work += [(2 * k + 1, rows[less], level + 1, *bounds[0]), (2 * k + 2, rows[~less], level + 1, *bounds[1])]
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees from at most fit_rows labelled documents; None where no label or only one class is found."""
    ready(docs.sparkSession)
    picked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        for b in batches:
            x = metrics(b.column("text"))[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "quality", *names])

    # the sample has fit_rows rows at most, so sending it to each executor is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"), "text")
    got = rows.mapInArrow(run, "doc_id long, quality long, " + ", ".join(f"{n} double" for n in names)).groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("v")).select("doc_id", "v.*").toPandas().sort_values("doc_id")
    y = (got["quality"].to_numpy(float) > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(got[names].to_numpy(float), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdicts(column: pa.Array, trees: Trees | None, threshold: float) -> dict[str, np.ndarray]:
    counts, x = metrics(column)
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    score = trees.score(x) if trees is not None else np.ones(len(x))
    return counts | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}


def score_documents(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """One row per document with its counts, its score and whether it is kept.

    A null text counts as empty; a text without words has zeros everywhere and fails. Without
    labels of both classes (an empty table, say) every score is 1 and only the base rule decides.
    Repeated rows get the same result each. Other columns of docs are ignored.
    """
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            v = verdicts(b.column("text"), trees, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, v.values())], names=["doc_id", *v])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdicts(b.column("text"), trees, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
