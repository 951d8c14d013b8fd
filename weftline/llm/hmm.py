"""Hidden Markov language model: Baum-Welch counts from all partitions, exact scores by the scaled forward recursion.

The model's symbols are the most frequent words, one class of rarer words for each hash of a word's
last bytes, and the end of a text. A rarer word's probability is its class's times its own
smoothed share of the class, so the model is a distribution over all words, seen or not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import ready, remainder, save, table, text_slices

#: Words that have symbols of their own at most, and classes of the rest: usual values, parameters of score.
STATES, WORDS, CLASSES = 8, 4096, 128
#: The most frequent words, so many at most, whose counts all tasks know; other words' counts are joined.
KNOWN = 1 << 17
#: Steps of the logarithmic scale that finds the least count of a known word, for each doubling.
FINE = 16
#: Rounds over all training documents that place documents in clusters after each doubling of these, and Baum-Welch rounds.
START_ROUNDS, ROUNDS = 3, 2
BATCH_TOKENS = 1_000_000
ADD = 0.1
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)


def classes(w: tv.Words, data: np.ndarray) -> np.ndarray:
    """Each word's class, from its last three bytes."""
    end, out = w.starts + w.lengths, np.zeros(len(w.starts), np.uint64)
    for k in range(3):
        ok = w.lengths > k
        out[ok] |= _LOW[data[end[ok] - 1 - k]] << np.uint64(8 * k)
    return (tv.mix(out) % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        emit = emit + 1e-3
        move = move + 1e-2
        start = start + 1e-2
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(sequences: list[np.ndarray]):
    """Runs of sequences of BATCH_TOKENS in all at most, or of one; each longest first, as (rows, symbols by step, rows by step)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        rows, n = [], 0
        while at < len(order) and (not rows or n + len(sequences[order[at]]) <= BATCH_TOKENS):
            rows.append(order[at])
            n += len(sequences[order[at]])
            at += 1
        length = np.array([len(sequences[i]) for i in rows])
        active = np.searchsorted(-length, -np.arange(length[0]), "left")  # rows longer than each step
        begin = np.concatenate([[0], np.cumsum(active)])
        by_step = np.empty(n, np.int64)
        for k, i in enumerate(rows):
            by_step[begin[: length[k]] + k] = sequences[i]
        yield rows, by_step, begin


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each symbol sequence (none is empty)."""
    out = np.zeros(len(sequences))
    for rows, symbols, begin in _batches(sequences):
        log, a = np.zeros(len(rows)), None
        for t in range(len(begin) - 1):
            n = begin[t + 1] - begin[t]
            a = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else a[:n] @ model.move) * model.emit[symbols[begin[t] : begin[t + 1]]]
            s = a.sum(1)
            a /= s[:, None]
            log[:n] += np.log(s)
        out[rows] = log
    return out


def expected(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over the sequences (the E step)."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    short = [s for s in sequences if len(s) <= BATCH_TOKENS]
    for s in sequences:
        if len(s) > BATCH_TOKENS:
            for t, x in zip((start, move, emit), expected_long(model, s), strict=True):
                t += x
    for _, symbols, begin in _batches(short):
        steps, total = len(begin) - 1, len(symbols)
        alpha, scale = np.empty((total, k)), np.empty(total)
        for t in range(steps):
            lo, hi = begin[t], begin[t + 1]
            a = (np.broadcast_to(model.start, (hi - lo, k)) if t == 0 else alpha[begin[t - 1] : begin[t - 1] + hi - lo] @ model.move) * model.emit[symbols[lo:hi]]
            scale[lo:hi] = s = a.sum(1)
            alpha[lo:hi] = a / s[:, None]
        nxt = None  # emission times beta of the next step, by its scale
        for t in range(steps - 1, -1, -1):
            lo, hi = begin[t], begin[t + 1]
            beta = np.ones((hi - lo, k))
            if nxt is not None:
                m = len(nxt)
                move += (alpha[lo : lo + m].T @ nxt) * model.move
                beta[:m] = nxt @ model.move.T
            nxt = model.emit[symbols[lo:hi]] * beta
            nxt /= scale[lo:hi, None]
            alpha[lo:hi] *= beta
        start += alpha[: begin[1]].sum(0)
        for j in range(k):
            emit[:, j] += np.bincount(symbols, alpha[:, j], len(emit))
    return start, move, emit


def expected_long(model: Hmm, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The E step of one very long sequence. The forward pass keeps its state at the borders of about sqrt(n) parts; each part is walked again, last part first, so memory grows with the root of the length."""
    n, k = len(symbols), len(model.start)
    size = max(1, int(np.sqrt(n)))
    borders = [None]  # the state before each part

    def forward_part(lo: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = symbols[lo : lo + size]
        alpha, scale = np.empty((len(own), k)), np.empty(len(own))
        for t, s in enumerate(own):
            a = (model.start if before is None else before @ model.move) * model.emit[s]
            scale[t] = a.sum()
            before = alpha[t] = a / scale[t]
        return alpha, scale

    for lo in range(0, n, size):
        borders.append(forward_part(lo, borders[-1])[0][-1])
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    nxt = None
    for part in range(len(borders) - 2, -1, -1):
        lo = part * size
        alpha, scale = forward_part(lo, borders[part])
        own = symbols[lo : lo + size]
        for t in range(len(own) - 1, -1, -1):
            beta = np.ones(k)
            if nxt is not None:
                move += np.outer(alpha[t], nxt) * model.move
                beta = model.move @ nxt
            nxt = model.emit[own[t]] * beta / scale[t]
            alpha[t] *= beta
        for j in range(k):
            emit[:, j] += np.bincount(own, alpha[:, j], len(emit))
        if not part:
            start += alpha[0]
    return start, move, emit


def cluster_counts(log_emit: np.ndarray, log_share: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and symbol counts (symbols x clusters) by the likeliest cluster of each sequence's symbols (none is empty)."""
    k = log_emit.shape[1]
    docs, counts = np.zeros(k), np.zeros(log_emit.size)
    for rows, n in _packed(sequences):
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        own = (np.add.reduceat(log_emit[rows], at, axis=0) + log_share).argmax(1)
        docs += np.bincount(own, minlength=k)
        counts += np.bincount(rows * k + np.repeat(own, n), minlength=len(counts))
    return docs, counts.reshape(log_emit.shape)


def _packed(sequences: list[np.ndarray]):
    """Symbols of runs of sequences, one after another, and their lengths."""
    for part in _runs(sequences, BATCH_TOKENS):
        yield np.concatenate(part), np.array([len(x) for x in part])


def doubled(counts: np.ndarray, docs: np.ndarray, states: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice the clusters, states at most: the largest are split into two that lean to one half of the symbols each."""
    k = counts.shape[1]
    more = np.argsort(-counts.sum(0), kind="stable")[: states - k]
    lean = np.random.default_rng(turn).uniform(0.5, 1.5, (len(counts), len(more)))
    split = counts.copy()
    split[:, more] = counts[:, more] * lean
    docs = docs.copy()
    docs[more] /= 2
    return np.concatenate([split, counts[:, more] * (2 - lean)], 1), np.concatenate([docs, docs[more]])


def begin_states(total: np.ndarray, states: int, count) -> Hmm:
    """A first model: states from clusters of all documents by their symbols, which double from one up. total has each symbol's count; count(log_emit, log_share) sums cluster_counts over all documents."""
    docs, counts = np.ones(1), total[:, None].astype(float)
    share = total / max(1.0, total.sum())
    back = lambda c: c + (0.02 * c.sum(0) + 1.0) * share[:, None]
    turn = 0
    while counts.shape[1] < states:
        turn += 1
        counts, docs = doubled(counts, docs, states, turn)
        for _ in range(START_ROUNDS):
            emit = back(counts) + 1e-3
            docs, counts = count(np.log(emit / emit.sum(0)), np.log((docs + 1) / (docs + 1).sum()))
    near = 50 * share[:, None] * np.random.default_rng(1).uniform(0.8, 1.2, (len(total), states))
    return Hmm.of_counts(docs, 20 * np.eye(states) + 1, counts + near)


def _count_words(docs: DataFrame) -> DataFrame:
    """h, c, cls: each distinct word's hash, count and class."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, c, k = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, where = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(where, c, len(u)).astype(np.int64), k[first]

        def batch(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], names=["h", "c", "cls"])

        for b in batches:
            for _, _, data, offs in text_slices(b.column("text")):
                w = tv.words(data, offs)
                u, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                held.append((u, n, classes(w, data)[first]))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield batch(held[0])
                        held = []
        if held:
            yield batch(merged())

    return docs.select("text").mapInArrow(run, "h long, c long, cls long").groupBy("h").agg(F.sum("c").alias("c"), F.min("cls").alias("cls"))


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; docs has doc_id, text and train (boolean).

    Word counts, class totals, the clusters that states start from and Baum-Welch counts are sums over
    all training documents. Scores cover whole texts; a null or empty text is the
    end alone. Repeated rows count and score each. Without training documents both scores follow from
    smoothing alone. Tasks hold KNOWN words' counts at most; other words are joined by hash. words: how
    many words have symbols of their own (65,000 at most); the rest share their classes' symbols.
    """
    if not 0 <= words <= 65_000:
        raise ValueError("words must be 0 to 65,000")
    end, symbols = words + CLASSES, words + CLASSES + 1
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    counts = save(_count_words(docs.where("train")), "counts")
    ends = docs.where("train").count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, n_types = n_words + ends, n_types + (ends > 0)
    # the least count of a known word, by the sizes of logarithmic classes; then only words above it come here
    level = F.floor(F.log2("c") * FINE).cast("int")
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, least = 0, 1 << 20
    for k, n in sizes:
        if held + n > KNOWN:
            break
        held, least = held + n, k
    top = counts.where(level >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    by_class = np.zeros((CLASSES, 2))
    for r in counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        by_class[r["cls"]] = r["c"], r["v"]
    own = top.head(words)
    np.subtract.at(by_class, own["cls"].to_numpy(np.int64), np.stack([own["c"], np.ones(len(own))], 1).astype(float))
    class_norm = np.log10(by_class[:, 0] + ADD * (by_class[:, 1] + 1))
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order], order))

    def encode(batches):
        hashes, c, rank = known.value
        lo_c = np.log10(c + ADD)
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column("text")):
                w = tv.words(data, offs)
                n, text = hi - lo, w.text_of
                at = np.minimum(np.searchsorted(hashes, w.hashes), max(len(hashes) - 1, 0))
                hit = hashes[at] == w.hashes if len(hashes) else np.zeros(len(w.hashes), bool)
                cls = classes(w, data)
                rare = ~hit if not len(hashes) else ~hit | (rank[at] >= words)
                symbol = words + cls
                symbol[~rare] = rank[at[~rare]]
                logs = np.where(hit, lo_c[at], 0.0) if len(hashes) else np.zeros(len(cls))
                all_log = np.bincount(text, logs, n).astype(float)
                rare_log = np.bincount(text[rare], (logs - class_norm[cls])[rare], n).astype(float)
                place = np.arange(len(symbol)) + text  # an end after each text
                stream = np.full(len(symbol) + n, end, "<u2")
                stream[place] = symbol
                ends_ = w.offsets + np.arange(n + 1)
                unseen = w.hashes[~hit].view(np.int64)
                tail = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), b.column("train").slice(lo, n), pa.array(w.counts + 1), pa.array(np.bincount(text[hit], minlength=n).astype(np.int64)), pa.array(all_log), pa.array(rare_log), pa.array([stream[i:j].tobytes() for i, j in zip(ends_[:-1].tolist(), ends_[1:].tolist(), strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(tail), pa.array(unseen))],
                    names=["doc_id", "train", "n_tokens", "n_hit", "all_log", "rare_log", "symbols", "tail"],
                )

    schema = "doc_id long, train boolean, n_tokens long, n_hit long, all_log double, rare_log double, symbols binary, tail array<long>"
    coded = save(docs.mapInArrow(encode, schema).withColumn("row_id", F.monotonically_increasing_id()), "coded")
    known.destroy()

    def summed(task, send, size: int) -> np.ndarray:
        """The sums that a task of a broadcast makes of the training documents' symbols, over all of them."""
        sent = spark.sparkContext.broadcast(send)

        def run(batches):
            flat = np.zeros(size)
            for b in batches:
                for part in _runs([np.frombuffer(x, "<u2").astype(np.int64) for x in b.column("symbols").to_pylist()]):
                    flat += np.concatenate([t.ravel() for t in task(sent.value, part)])
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some])], names=["at", "v"])

        got = coded.where("train").select("symbols").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        sent.destroy()
        flat = np.zeros(size)
        flat[got["at"].to_numpy(np.int64)] = got["v"].to_numpy(float)
        return flat

    def by_cluster(log_emit: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(log_share)
        flat = summed(lambda sent, part: cluster_counts(*sent, part), (log_emit, log_share), k + log_emit.size)
        return flat[:k], flat[k:].reshape(log_emit.shape)

    total = np.concatenate([np.zeros(words), by_class[:, 0], [ends]])
    total[: len(own)] = own["c"].to_numpy(float)
    model = begin_states(total, states, by_cluster) if ends else Hmm.of_counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))
    for _ in range(rounds if ends else 0):
        flat = summed(expected, model, states + states * states + symbols * states)
        start, move, emit = np.split(flat, [states, states + states * states])
        model = Hmm.of_counts(start, move.reshape(states, states), emit.reshape(symbols, states))
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        for b in batches:
            parts = [forward(final.value, part) for part in _runs([np.frombuffer(x, "<u2").astype(np.int64) for x in b.column("symbols").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row_id", "doc_id", "train", "n_tokens", "n_hit", "all_log", "rare_log")), pa.array(np.concatenate(parts) / np.log(10) if parts else np.zeros(0))], names=["row_id", "doc_id", "train", "n_tokens", "n_hit", "all_log", "rare_log", "log_p"])

    scored = coded.drop("tail").mapInArrow(likelihood, "row_id long, doc_id long, train boolean, n_tokens long, n_hit long, all_log double, rare_log double, log_p double")
    tail = coded.select("row_id", F.explode("tail").alias("h"))
    found = tail.join(counts.select("h", "c"), "h", "left").groupBy("row_id").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("tail_log"), F.count("c").alias("tail_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_log = F.col("all_log") + zero("tail_log") + float(np.log10(ends + ADD))
    base = all_log - F.col("n_tokens") * float(np.log10(n_train + ADD * (n_types + 1)))
    return scored.join(found, "row_id", "left").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_hit") + zero("tail_known") + int(ends > 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_p") + F.col("rare_log") + zero("tail_log")).alias("score"))


def _runs(sequences: list[np.ndarray], most: int = 4 * BATCH_TOKENS):
    """Sequences in order, in runs of bounded length."""
    held, n = [], 0
    for s in sequences:
        if held and n + len(s) > most:
            yield held
            held, n = [], 0
        held.append(s)
        n += len(s)
    if held:
        yield held


def op7_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (remainder("doc_id", 10) != 0).alias("train")))
