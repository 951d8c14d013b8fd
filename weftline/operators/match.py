"""Joins that resolution is made of: tiers, as-of, ranges, prefixes, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one value that a block of pairs takes from either side, about.
BLOCK = 1024


def first_tier(found: DataFrame, key: str) -> DataFrame:
    """All matches of the first tier that has any for a reference."""
    return found.withColumn("_best", F.min("tier").over(W.partitionBy(key))).where("tier = _best").drop("_best")


def sharing(asks: DataFrame, known: DataFrame, on: str, key: str) -> DataFrame:
    """key, target: each row of asks (key, on) with each of known (on, self, target) that shares its value and is not itself.

    The rows of a value are cut into blocks of about BLOCK on either side, and the pairs of blocks are
    dealt by value and both numbers: n rows of one value send n / BLOCK copies of themselves, no task
    holds them all, and the pairs themselves are not shuffled. A block of known travels as one array, so
    the join meets a row and a block; the pairs come out of a plain loop over the array. Repeats of one
    self are dealt to different blocks. The parts are as many as the session says: a few MB of blocks
    make very many pairs, so parts must not be put together by their size, nor a side be broadcast for it.
    """
    blocks = lambda df, name: df.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = blocks(asks, "_nl").join(blocks(known, "_nr"), on)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asks.join(sizes, on).select(on, key, F.pmod(F.xxhash64(key), "_nl").alias("_i"), each("_nr").alias("_j"))
    repeat = F.row_number().over(W.partitionBy(on, "self").orderBy("target"))
    dealt = known.withColumn("_r", repeat).join(sizes, on).withColumn("_j", F.pmod(F.xxhash64("self", "_r"), "_nr"))
    right = dealt.groupBy(on, "_j", "_nl").agg(F.collect_list(F.struct("self", "target")).alias("_all")).select(on, "_j", "_all", each("_nl").alias("_i"))
    left = left.repartition(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), on, "_i", "_j")
    return left.join(right.hint("merge"), [on, "_i", "_j"]).select(key, F.inline("_all")).where(F.col("self") != F.col(key)).select(key, "target")


def tiered(key: str, tiers: list[DataFrame | tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """All matches of the first tier that has any for a reference.

    A tier is a frame of key and target, already joined, or asks, known and their common column as
    sharing takes them. Of the latter only one row for each reference takes part in the choice, and
    only references that no earlier tier resolves are joined, for their pairs may be very many.
    """
    rows = []
    for i, t in enumerate(tiers):
        if isinstance(t, DataFrame):
            rows.append(t.select(key, "target", F.lit(None).cast("string").alias("_on"), F.lit(i).alias("tier")))
            continue
        asks, known, on = t
        ends = known.groupBy(on).agg(F.min("self").alias("_lo"), F.max("self").alias("_hi"))
        hit = asks.join(ends, on).where((F.col("_lo") != F.col(key)) | (F.col("_hi") != F.col(key)))
        rows.append(hit.select(key, F.lit(None).cast("string").alias("target"), F.col(on).alias("_on"), F.lit(i).alias("tier")))
    best = first_tier(reduce(DataFrame.unionByName, rows), key)
    wide = [(i, t) for i, t in enumerate(tiers) if not isinstance(t, DataFrame)]
    out = [best.where(~F.col("tier").isin([i for i, _ in wide])).select(key, "target", "tier")]
    for i, (_, known, on) in wide:
        out.append(sharing(best.where(F.col("tier") == i).select(key, F.col("_on").alias(on)), known, on, key).withColumn("tier", F.lit(i)))
    return reduce(DataFrame.unionByName, out)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same keys at or before its position; rows without one keep nulls."""
    rows = left.withColumn("_l", F.struct(*left.columns))
    both = rows.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), "_l", F.lit(None).cast(right.select(F.struct(when, *values).alias("r")).schema["r"].dataType).alias("_r")).unionByName(
        right.select(*keys, F.col(when).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.struct(when, *values).alias("_r"))
    )
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *(F.col(f"_r.{v}").alias(v) for v in values))


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, lo: str, hi: str, tie: str) -> DataFrame:
    """For each point the smallest range of the same keys that holds it (lo <= point < hi); ties by tie. Points outside all are dropped."""
    inside = points.join(ranges, keys).where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)))
    w = W.partitionBy(*keys, *[c for c in points.columns if c not in keys]).orderBy(F.col(hi) - F.col(lo), tie)
    return inside.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prefix_routes(routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Routes (url) with the patterns (pattern) they match: the same text, or for a pattern that ends in /* a text that goes on after its slash. Prefixes are joined by equality, one row for each level above the url's own."""
    exact = routes.join(patterns, F.col("url") == F.col("pattern"))
    steps = F.split("url", "/")
    levels = routes.where(F.size(steps) > 1).withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/*")))))
    wide = levels.join(patterns.where(F.col("pattern").endswith("/*")), F.col("_p") == F.col("pattern")).drop("_p")
    return exact.unionByName(wide).distinct()


def unique_or_ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its number of distinct values and the value if there is one only."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("_v")).select(key, "n", F.when(F.col("n") == 1, F.col("_v")).alias("value"))


def missing(refs: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return refs.join(known.select(on).distinct(), on, "left_anti")


def confidence(n: Column, exact: Column) -> Column:
    """1 for an exact match, 0.8 for a single short one, 0.5 for several."""
    return F.when(exact, 1.0).when(n == 1, 0.8).otherwise(0.5)
