"""Analysis of a tree and its index: build, save, load, validate, and the rules of queries from outside."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scratch import exists, replace_table
from weftline.operators import merge
from weftline.plans import resolve
from weftline.plans.resolve import EVIDENCE, Graph
from weftline.sources import cache, project

# Limits of a query.
QUERY_POINTS, QUERY_TOKENS, QUERY_BYTES = 1024, 64, 64 * 1024
NODES = f"id string, name string, type string, file_path string, evidence {EVIDENCE}, search_text array<string>, data map<string,string>"
EDGES = f"id string, source string, target string, type string, confidence double, reason string, evidence {EVIDENCE}"
_MACHINE = r"(?:^|[\s'\"(=])(?:/(?:home|Users|root|tmp|var|opt|mnt)/|[A-Za-z]:\\)"


class Invalid(ValueError):
    """An index or a query that breaks the rules; args hold what is wrong."""


@dataclass
class Analysis:
    graph: Graph
    facts: DataFrame
    statuses: dict[str, int]  # files by status
    reused: int  # files whose facts came from the cache
    diagnostics: list[str] = field(default_factory=list)
    millis: dict[str, float] = field(default_factory=dict)  # by phase


def analyze(spark: SparkSession, root: str, cache_path: str | None = None, ignore: tuple[str, ...] = ()) -> Analysis:
    """Scan, parse what the cache does not hold, resolve. Times are by phase."""
    marks = [("", time.perf_counter())]
    files = project.scan(spark, root, ignore)
    statuses = {r["status"]: r["n"] for r in files.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    marks.append(("scan", time.perf_counter()))
    facts, live = cache.extract(files, cache.load(spark, cache_path) if cache_path else None)
    facts, reused = resolve.cut(facts), cache.reused_files(live)
    problem = cache.save(facts, cache_path) if cache_path else ""
    marks.append(("parse", time.perf_counter()))
    graph = resolve.build(facts)
    marks.append(("resolve", time.perf_counter()))
    millis = {name: 1000 * (at - before) for (_, before), (name, at) in zip(marks, marks[1:], strict=False)}
    return Analysis(graph, facts, statuses, reused, [f"cache not written: {problem}"] if problem else [], millis | {"total": 1000 * (marks[-1][1] - marks[0][1])})


def summary(graph: Graph) -> DataFrame:
    """(what, type, n) of nodes and edges."""
    return merge.type_counts(graph.nodes).select(F.lit("nodes").alias("what"), "type", "n").unionByName(merge.type_counts(graph.edges).select(F.lit("edges").alias("what"), "type", "n"))


def save(graph: Graph, path: str) -> None:
    """Write an index; each of its tables is replaced as a whole, the counts last."""
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("warnings", graph.warnings), ("summary", summary(graph))):
        replace_table(df, f"{path}/{name}")


def validate(graph: Graph, counts: DataFrame | None = None) -> list[str]:
    """What is wrong with a graph: rules of nodes and edges, machine paths in warnings, and counts other than the stored ones. At most 100 findings."""
    found = resolve.problems(graph.nodes, graph.edges).select(F.concat_ws(" ", "problem", "id").alias("x"))
    found = found.unionByName(graph.warnings.where(F.col("subject").rlike(_MACHINE)).select(F.lit("machine path in a warning").alias("x")))
    if counts is not None:
        both = counts.join(summary(graph).withColumnRenamed("n", "now"), ["what", "type"], "full").where("not n <=> now")
        found = found.unionByName(both.select(F.concat_ws(" ", F.lit("count of"), "what", "type").alias("x")))
    return sorted(r["x"] for r in found.limit(100).collect())


def load(spark: SparkSession, path: str) -> Graph:
    """Read an index and check it; raises Invalid where it is empty or wrong."""
    if not exists(spark, f"{path}/summary"):
        raise Invalid(f"no index at {path}")
    nodes, edges = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("nodes", NODES), ("edges", EDGES)))
    graph = Graph(nodes, edges, spark.read.schema("code string, subject string").parquet(f"{path}/warnings"))
    if nodes.isEmpty():
        raise Invalid("an index without nodes")
    if wrong := validate(graph, spark.read.schema("what string, type string, n long").parquet(f"{path}/summary")):
        raise Invalid(*wrong)
    return graph


def load_or_build(spark: SparkSession, target: str) -> Graph:
    """The graph of an index, or of a tree: its own index in .weft if there is one, else a new one that is kept there."""
    if exists(spark, f"{target}/summary"):
        return load(spark, target)
    own = f"{target}/.weft"
    if not exists(spark, f"{own}/index/summary"):
        save(analyze(spark, target, f"{own}/facts").graph, f"{own}/index")
    return load(spark, f"{own}/index")


def checked_query(text: str) -> str:
    """A query from outside, trimmed; raises Invalid for an empty or overlong one, too many words or control characters."""
    text = text.strip()
    wrong = [
        name
        for name, on in (
            ("empty query", not text),
            (f"more than {QUERY_POINTS} characters", len(text) > QUERY_POINTS),
            (f"more than {QUERY_TOKENS} words", len(text.split()) > QUERY_TOKENS),
            ("control characters", any(ord(c) < 32 or 127 <= ord(c) < 160 for c in text)),
        )
        if on
    ]
    if wrong:
        raise Invalid(*wrong)
    return text


def query_file(root: str, path: str) -> str:
    """The query in a file of the tree: a plain file with one link inside the tree, of bounded size, in UTF-8."""
    top, full = os.path.realpath(root), os.path.abspath(os.path.join(root, path))
    if os.path.realpath(full) != os.path.join(os.path.realpath(os.path.dirname(full)), os.path.basename(full)) or os.path.commonpath([top, os.path.realpath(full)]) != top:
        raise Invalid("a query file must be a plain file inside the project")
    with open(full, "rb") as f:
        info = os.fstat(f.fileno())
        if info.st_nlink != 1 or info.st_size > QUERY_BYTES:
            raise Invalid("a query file must have one link and a bounded size")
        try:
            return checked_query(re.sub(r"[\r\n]+", " ", f.read().decode("utf-8").strip()))
        except UnicodeDecodeError as e:
            raise Invalid("a query file must be UTF-8") from e
