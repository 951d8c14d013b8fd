"""Ranked search over nodes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import nfkc

# Scores by kind of match.
NAME_EQUAL, ID_EQUAL, NAME_PART, ID_PART, VALUE_EQUAL, VALUE_PART, ALL_TOKENS = 1000, 950, 850, 800, 750, 650, 500
SEARCH_LIMIT, START_MATCHES, STARTS = 25, 10, 5


def normal(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").lower().strip()


def score(term: str, name: Column, id_: Column, path: Column, texts: Column) -> Column:
    """Score of a node for a normalised term, over normalised columns; 0: no match."""
    if not term:
        return F.lit(0)
    tokens = [F.lit(t) for t in term.split()]
    t = F.lit(term)
    values = F.array_compact(F.concat(F.array(name, id_, path), texts))
    all_in = lambda v: F.forall(F.array(*tokens), lambda k: F.contains(v, k))
    spread = F.forall(F.array(*tokens), lambda k: F.exists(texts, lambda v: F.contains(v, k)))
    return (
        F.when(name == t, NAME_EQUAL)
        .when((id_ == t) | F.endswith(id_, F.lit(f":{term}")), ID_EQUAL)
        .when(F.contains(name, t), NAME_PART)
        .when(F.contains(id_, t), ID_PART)
        .when(F.exists(values, lambda v: v == t), VALUE_EQUAL)
        .when(F.exists(values, lambda v: F.contains(v, t)), VALUE_PART)
        .when(F.exists(values, all_in) | spread, ALL_TOKENS)
        .otherwise(0)
    )


def scored(nodes: DataFrame, query: str, types: list[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """Nodes with a score above 0. ascii_only keeps normalising in the JVM where all values are ASCII."""
    term = normal(query)
    if types:
        nodes = nodes.where(F.col("type").isin(types))
    n = (lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))) if ascii_only else (lambda c: nfkc(F.coalesce(c, F.lit(""))))
    path = F.col("file_path") if "file_path" in nodes.columns else F.lit(None).cast("string")
    texts = F.filter(F.coalesce("search_text", F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")) if "search_text" in nodes.columns else F.array().cast("array<string>")
    texts = F.transform(texts, n) if ascii_only else nfkc_all(texts)
    cols = nodes.withColumns({"_n": n(F.col("name")), "_i": n(F.col("id")), "_p": F.when(path.isNotNull(), n(path)), "_t": texts})
    return cols.withColumn("score", score(term, F.col("_n"), F.col("_i"), F.col("_p"), F.col("_t"))).drop("_n", "_i", "_p", "_t").where("score > 0")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_all(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [normal(x) for x in v])


def by_id() -> Column:
    """Ids in the order of the root locale."""
    return F.collate(F.col("id"), "UNICODE")


def search(nodes: DataFrame, query: str, limit: int = SEARCH_LIMIT, types: list[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """The best matches, by score and then id in the order of the root locale."""
    return scored(nodes, query, types, ascii_only).orderBy(F.desc("score"), by_id()).limit(limit)


def starts(nodes: DataFrame, query: str, types: list[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """Where a trace begins: of the first matches those with the top score, at most STARTS, in the order of the search."""
    top = search(nodes, query, START_MATCHES, types, ascii_only)
    # at most START_MATCHES rows
    best = top.withColumn("_best", F.max("score").over(W.partitionBy(F.lit(0))))
    return best.where("score = _best").drop("_best").orderBy(by_id()).limit(STARTS)


def per_type(nodes: DataFrame, query: str, k: int = 8, ascii_only: bool = False) -> DataFrame:
    """The k best of each type with a flag whether the type had more."""
    found = scored(nodes, query, None, ascii_only)
    w = W.partitionBy("type")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), by_id()))).where(F.col("rank") <= k + 1)
    return ranked.withColumn("truncated", F.max("rank").over(w) > k).where(F.col("rank") <= k)
