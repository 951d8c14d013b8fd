"""Budgets, caps and positions: prefixes by bytes, top rows with flags, places in a whole order, greedy batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scratch import cut


def byte_prefix(df: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The first lines of each group whose bytes with line ends stay within a budget."""
    w = W.partitionBy(group).orderBy(order)
    return df.withColumn("bytes", F.sum(F.octet_length(text) + 1).over(w)).where(F.col("bytes") <= budget)


def capped(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group, and whether it had more."""
    w = W.partitionBy(group)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("rank") <= k + 1).withColumn("truncated", F.max("rank").over(w) > k).where(F.col("rank") <= k)


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add position, from 1 over all rows: parts by ranges of the order, rows numbered in their sorted part, and the running counts of the parts."""
    at = F.monotonically_increasing_id()  # the part above 33 bits of the row's number in it
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + own + 1).drop("_at", "_part", "_before")


def pack_batches(df: DataFrame, kind: str, size: str, path: str, most_bytes: int, most_files: int) -> DataFrame:
    """Greedy batches of one kind: by size descending and path, a batch closes before it would pass a limit. Adds batch, from 0 within the kind.

    The cut depends on the running batch, so a kind is scanned in order in one group of (path, size)
    rows; kinds run in parallel.
    """
    schema = df.select(kind, path, F.col(size).cast("long").alias(size)).schema.add("batch", T.IntegerType())

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, path], ascending=[False, True], kind="stable")
        out, batch, held, n = [], 0, 0, 0
        for s in pdf[size].tolist():
            if n and (held + s > most_bytes or n >= most_files):
                batch, held, n = batch + 1, 0, 0
            out.append(batch)
            held, n = held + s, n + 1
        return pdf.assign(batch=out)

    return df.select(kind, path, F.col(size).cast("long").alias(size)).groupBy(kind).applyInPandas(cut, schema)
