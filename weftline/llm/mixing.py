"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.budget import positions

from . import textvec as tv
from .common import fresh, numbered, ready, save, sent, table, text_digest, text_slices

#: Documents of one source whose probabilities are moved together, and leftovers of blocks at each later level.
BLOCK_DOCS, BLOCKS_JOINED = 2000, 500
#: Documents of each power of two in size that a source keeps for the end.
RESERVE = 4
#: Equal rows that one task writes out.
ROWS_AT_ONCE = 10_000
_TINY = 1e-9


def flight(prob: list[float], size: list[int], rand: random.Random) -> None:
    """Move probabilities in place until at most two lie strictly between 0 and 1; their sum and their sum weighted by size stay.

    Three units at a time move along the vector that both constraints leave free; the end of the way
    up or down is drawn so that each unit's expected value is its probability.
    """
    held: list[int] = []
    for i in range(len(prob)):
        if not _TINY < prob[i] < 1 - _TINY:
            prob[i] = float(round(prob[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            way = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(way):
                way = (1, -1, 0)
            up = min((1 - prob[k]) / u if u > 0 else prob[k] / -u for k, u in zip(held, way, strict=True) if u)
            down = min(prob[k] / u if u > 0 else (1 - prob[k]) / -u for k, u in zip(held, way, strict=True) if u)
            step = up if rand.random() * (up + down) < down else -down
            for k, u in zip(held, way, strict=True):
                prob[k] += step * u
                if prob[k] < _TINY or prob[k] > 1 - _TINY:
                    prob[k] = float(round(prob[k]))
            held = [k for k in held if 0 < prob[k] < 1]


def land(prob: list[float], size: list[int], rand: random.Random) -> None:
    """Settle the few units that are left: without the constraint on their number two move along the words alone, and the last is rounded."""
    open_ = [i for i, p in enumerate(prob) if 0 < p < 1]
    while len(open_) > 1:
        a, b = open_[:2]
        way = (size[b], -size[a]) if size[a] or size[b] else (1, -1)
        ends = lambda s: min((1 - prob[k]) / (s * u) if s * u > 0 else prob[k] / -(s * u) for k, u in zip((a, b), way, strict=True) if u)  # noqa: E731, B023
        up, down = ends(1), ends(-1)
        step = up if rand.random() * (up + down) < down else -down
        for k, u in zip((a, b), way, strict=True):
            prob[k] += step * u
            if prob[k] < _TINY or prob[k] > 1 - _TINY:
                prob[k] = float(round(prob[k]))
        open_ = [k for k in open_ if 0 < prob[k] < 1]
    for i in open_:
        prob[i] = float(prob[i] > 0.5)


def repair(copies: list[int], size: list[int], error: float, most: int, rounds: int = 50) -> float:
    """Change copies in place, each within 0 and `most`, so that the words still wanted (error) come close to none: in each round the best change of one or two units. Returns what is left."""
    unit = np.repeat(np.arange(len(size)), most)
    for _ in range(rounds):
        now, sizes = np.array(copies, np.int64), np.array(size, np.int64)
        step = np.array([d for c in copies for d in range(-c, most + 1 - c) if d], np.int64)
        if not len(step) or abs(error) < 0.5:
            break
        gain = step * sizes[unit]
        both = np.abs(error - gain[:, None] - np.where(unit[:, None] == unit[None], 0, gain[None]))
        i, j = divmod(int(np.argmin(both)), len(gain))
        if both[i, j] >= abs(error) - 1e-6:
            break
        for k in (i, j) if unit[i] != unit[j] else (i,):
            now[unit[k]] += step[k]
            error -= float(gain[k])
        copies[:] = now.tolist()
    return error


def _move(key, pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    # large documents first, so that the units left at the end tend to be small ones
    pdf = pdf.sort_values(["size", "ord", "uid"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    prob = pdf["prob"].tolist()
    flight(prob, pdf["size"].tolist(), random.Random(f"{seed}/{'/'.join(map(str, key))}"))
    return pdf.assign(prob=prob)


def _settle(key, pdf: pd.DataFrame, seed: int, most: int) -> pd.DataFrame:
    """The last units of a source: flight, landing, and the reserve's copies set so that the words come to the target."""
    rest = _move(key, pdf, seed)
    prob, size, whole = rest["prob"].tolist(), rest["size"].tolist(), rest["whole"].tolist()
    land(prob, size, random.Random(f"{seed}/land/{key[0]}"))
    error = sum((a - b) * s for a, b, s in zip(rest["prob"], prob, size, strict=True))
    copies = [w + int(p) for w, p in zip(whole, prob, strict=True)]
    held = [i for i, r in enumerate(rest["reserve"]) if r and size[i]]
    own = [copies[i] for i in held]
    repair(own, [size[i] for i in held], error, most)
    for i, c in zip(held, own, strict=True):
        copies[i] = c
    return rest[["uid"]].assign(landed=copies)


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (digest of the text), size: the words of each text; a null text has none."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [tv.words(data, offs).counts for _, _, data, offs in text_slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "h")), pa.chunked_array([pa.array(x) for x in found], pa.int64()).combine_chunks()], names=["doc_id", "source", "h", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_digest().alias("h"), "text").mapInArrow(run, "doc_id long, source string, h long, size long")


def with_targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sources (source, source_size) with their target: shares of all sizes by weight, the weights repeating over the sources by code point, null last; none above `most` times its size.

    Sources whose share reaches that limit are settled at it and the rest shared again, until no more
    reach it: one aggregation a round, so sources may be many.
    """
    placed = positions(sources.select("source", "source_size", F.col("source").isNull().alias("last")), ["last", "source"])
    placed = save(placed.select("source", "source_size", F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("position") - 1) % len(weights)).cast("int")).alias("weight")), "sources")
    all_size, all_weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    left, whole, settled, full, share = all_size, all_weight, 0, F.lit(False), F.lit(0.0)
    while left and whole > _TINY:
        share = F.lit(float(left)) * F.col("weight") / F.lit(whole)
        full = full | (share >= most * F.col("source_size"))
        n, over, weight = placed.where(full).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == settled:
            break
        settled, left, whole = n, all_size - most * over, all_weight - weight
    return placed.select("source", "source_size", F.when(full, most * F.col("source_size").cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 8) -> DataFrame:
    """For each distinct (doc_id, source, h) of docs: size, source_size, target, n (its rows), copies that each row gets, and more, of how many rows get one copy more."""
    sized = with_sizes(docs).groupBy("doc_id", "source", "h").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    units = save(sized.withColumn("uid", F.monotonically_increasing_id()), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    totals = save(totals, "totals")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = with_targets(totals.select("source", "source_size"), weights, most)
    rates = goal.join(totals.select(F.col("source").alias("_s"), "units"), F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    rates = rates.withColumn("whole", F.least(F.lit(most), F.floor(ratio + _TINY)).cast("int")).withColumn("rate", F.when(F.col("whole") < most, F.greatest(F.lit(0.0), ratio - F.col("whole"))).otherwise(0.0))
    rates = save(rates.select("_s", "source_size", "target", "whole", "rate", F.ceil(F.col("units") / BLOCK_DOCS).alias("blocks")), "rates")
    most_blocks = rates.agg(F.max("blocks")).first()[0] or 0
    rows = units.join(sent(rates), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # of equal rows a whole number is decided at once; one at most is left to the draw
    drawn = F.col("n") * F.col("rate")
    rows = rows.withColumn("more", F.floor(drawn + _TINY)).withColumn("prob", F.greatest(F.lit(0.0), drawn - F.col("more")))
    rows = rows.withColumn("ord", F.xxhash64("doc_id", "size", "h", F.lit(seed))).withColumn("up", F.pmod("ord", F.col("blocks")).cast("int"))
    # a few documents of each power of two in size are kept for the end, where they make up for what the landing misses
    rank = F.row_number().over(W.partitionBy("source", F.floor(F.log2(F.col("size") + 0.5))).orderBy("ord", "uid"))
    kept = rows.where("size > 0 and n = 1").select("uid", "source", "size", "ord").withColumn("rank", rank).where(F.col("rank") <= RESERVE)
    kept = save(kept.select("uid", F.lit(True).alias("reserve")), "reserve")
    rows = save(rows.join(sent(kept), "uid", "left").withColumn("reserve", F.coalesce("reserve", F.lit(False))), "rows")

    slim = "uid long, source string, size long, whole int, prob double, ord long, reserve boolean, up int"
    use = [c.split()[0] for c in slim.split(", ")]
    moved = save(rows.where("not reserve and prob > 0").select(*use).groupBy("source", "up").applyInPandas(lambda key, pdf: _move(key, pdf, seed), slim), "moved")
    settled, left = moved.where("prob = 0 or prob = 1"), moved.where("prob > 0 and prob < 1")
    while most_blocks > 1:
        most_blocks = -(-most_blocks // BLOCKS_JOINED)
        left = left.withColumn("up", (F.col("up") / BLOCKS_JOINED).cast("int"))
        moved = save(left.groupBy("source", "up").applyInPandas(lambda key, pdf: _move(key, pdf, seed), slim), "moved")
        settled, left = settled.unionByName(moved.where("prob = 0 or prob = 1")), moved.where("prob > 0 and prob < 1")
    last = left.unionByName(rows.where("reserve").select(*use))
    landed = last.groupBy("source").applyInPandas(lambda key, pdf: _settle((*key, "last"), pdf, seed, most), "uid long, landed long")
    landed = settled.select("uid", (F.col("whole") + F.col("prob")).cast("long").alias("landed")).unionByName(landed)
    rows = rows.join(landed, "uid", "left")
    one = F.col("n") == 1
    extra = F.col("more") + F.coalesce(F.col("landed") - F.col("whole"), F.lit(0))
    return rows.select("doc_id", "source", "h", "size", "source_size", "target", "n", F.when(one, F.coalesce("landed", F.col("whole") + F.col("more"))).otherwise(F.col("whole")).cast("long").alias("copies"), F.when(one, F.lit(0)).otherwise(extra).cast("long").alias("more"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 8) -> DataFrame:
    """For each document how often the mix takes it, so that each source's words come near its target.

    A source of ratio target / size takes each document floor(ratio) times and once more with the
    fraction as probability, by the cube method: blocks of documents are moved in parallel, what stays
    fractional (two a block) is moved again in larger groups, and the last of a source are
    settled by words alone. A few documents of each magnitude of size wait for that end; their copies, 0 to
    `most`, then make up for what the last rounding missed, so a target is met as closely as these
    sizes allow. Draws depend on ids, texts and the seed only, so reruns and other partitionings agree.
    Documents of size 0 cost nothing and are treated like others. Rows that agree in doc_id, source and
    text are documents of their own, decided together; a null source is a source; an empty table gives
    no rows. Other columns are ignored. Nothing but counts reaches the driver.
    """
    rows = plan(docs, weights, most, seed)
    part = rows.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ROWS_AT_ONCE).cast("long"))))
    part = part.repartition("doc_id", "h", "lo") if not rows.where(F.col("n") > ROWS_AT_ONCE).isEmpty() else part
    each = part.withColumn("at", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + ROWS_AT_ONCE, F.col("n")) - 1)))
    copies = F.col("copies") + F.when(F.col("at") < F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def taken(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 8) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns. What mix says of nulls, repeated rows and empty tables holds."""
    found = save(plan(docs, weights, most, seed).select("doc_id", "source", "h", "n", "copies", "more"), "plan")
    d, s, h, at, n, copies, more, k = fresh(docs, "_d", "_s", "_h", "_at", "_n", "_copies", "_more", "_k")
    side = lambda where: found.where(where).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h), F.col("copies").alias(copies), F.col("more").alias(more))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(at) == F.col(h))
    named = docs.withColumn(at, text_digest())
    times = lambda df, c: df.where(c > 0).withColumn(k, F.explode(F.sequence(F.lit(1), c.cast("int")))).select(docs.columns)
    even = "more = 0 and copies > 0"
    out = times(named.join(sent(save(side(even), "even")), same), F.col(copies))
    uneven = save(side("more > 0"), "uneven")
    if uneven.isEmpty():
        return out
    rows = numbered(named.join(sent(uneven), same), [d, s, h], n)
    return out.unionByName(times(rows, F.col(copies) + F.when(F.col(n) < F.col(more), 1).otherwise(0)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
