"""Fact cache: facts of earlier runs, reused for files whose path, content and parser version are the same."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scratch import exists, replace_table
from weftline.sources import parsers, project


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """Facts of a cache; None where there is none, or what is there has not the form of facts or cannot be read."""
    if not exists(spark, path):
        return None
    try:
        found = spark.read.parquet(path)
        want = spark.createDataFrame([], parsers.SCHEMA).schema
        if [(f.name, f.dataType.simpleString()) for f in found.schema] != [(f.name, f.dataType.simpleString()) for f in want]:
            return None
        found.limit(1).collect()
        return found
    except (PySparkException, Py4JJavaError):  # damaged files show as either
        return None


def save(facts: DataFrame, path: str) -> str:
    """Replace a cache by these facts, as a whole or not at all. Returns '' or what went wrong: a cache that cannot be written is no failure of the analysis."""
    try:
        replace_table(facts.repartitionByRange("path").sortWithinPartitions("path", "ord"), path)
        return ""
    except (PySparkException, Py4JJavaError, OSError) as e:
        return type(e).__name__


def extract(files: DataFrame, cached: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(facts of all parsed files, facts that came from the cache): only files that the cache does not hold are parsed."""
    todo, live = project.split_by_cache(files.where("status = 'parsed'"), cached, parsers.VERSION)
    fresh = parsers.facts(todo)
    return (fresh if live is None else fresh.unionByName(live.select(fresh.columns))), live


def reused_files(live: DataFrame | None) -> int:
    return 0 if live is None else live.agg(F.count_distinct("path")).first()[0]
