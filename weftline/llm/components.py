"""Connected components of a large graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of a link between two different ids; root is the smallest id reachable.

    Ids are of any type that has an order. Rounds go on until nothing changes. Each round is joins and grouped minima over the links, written to the shared folder. A node with
    very many neighbours is never gathered: its minimum is pre-aggregated and joined back. Nulls,
    loops and repeats are ignored; no links give no rows.
    """
    a, b = F.col(src), F.col(dst)
    edges = save(links.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u")))
        nxt = save(small.distinct(), "edges")
        drop(edges)
        edges, now = nxt, mark(nxt)
        if now == seen:
            break
        seen = now
    return edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root").unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
