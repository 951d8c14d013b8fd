"""Merging of graph rows: nodes by id, edges by first occurrence, ordered evidence, counts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as edges are deduplicated: later evidence is not merged."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(df.columns)


def ordered_union(values: str | Column, order: str | Column) -> Column:
    """Distinct items of an array column over a group, in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, (F.col(values) if isinstance(values, str) else values).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def merge_nodes(df: DataFrame, order: str = "ord", then: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: first name and type that are set, first path that is set, evidence and search text distinct in order, data by last value of each key.

    A node met once keeps its own evidence as it is; only merging removes repeats. Columns of then
    decide between rows of one order. Rows without an order come last and give no name, type or path.
    """
    o = F.struct(F.col(order).isNull().alias("late"), order, *then)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & F.col(order).isNotNull(), o)).alias(c)
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    data = F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), "data")), by_order), lambda r: F.coalesce(r["data"], F.create_map().cast("map<string,string>")))
    once = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), "evidence"))), lambda r: r["evidence"]))
    merged = F.aggregate(data, F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))
    return df.groupBy("id").agg(
        first("name"),
        first("type"),
        first("file_path"),
        F.when(F.count(F.lit(1)) == 1, once).otherwise(F.array_distinct(once)).alias("evidence"),
        ordered_union("search_text", o).alias("search_text"),
        merged.alias("data"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target is no node, each once: both ends go through one anti-join."""
    ends = edges.withColumn("_end", F.explode(F.array("source", "target")))
    ids = nodes.select(F.col("id").alias("_end")).distinct()
    return ends.join(ids, "_end", "left_anti").drop("_end").dropDuplicates(["id"])


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: orphans (edges without an end), node_repeats, edge_repeats."""
    ids = nodes.select("id", F.lit(0).alias("is_edge")).unionByName(edges.select("id", F.lit(1).alias("is_edge")))
    repeats = ids.groupBy("id", "is_edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count_if(F.col("is_edge") == 0).alias("node_repeats"), F.count_if(F.col("is_edge") == 1).alias("edge_repeats"))
    return orphan_edges(nodes, edges).agg(F.count(F.lit(1)).alias("orphans"), F.lit(0).alias("_k")).join(repeats.withColumn("_k", F.lit(0)), "_k").drop("_k")


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
