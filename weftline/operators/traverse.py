"""Bounded simple-path traversal, closures and context propagation over edge tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.scratch import Rounds
from weftline.operators import search

# Limits and the edge types of the trace modes.
MAX_DEPTH, MAX_PATHS, MAX_STATES = 14, 100, 5000
LINEAGE = ("maps_to", "dispatches_to", "forwards_to", "redirects_to", "uses_tile", "calls", "calls_procedure", "implements", "implemented_by", "uses_statement", "reads_from", "writes_to", "extends", "extends_tile", "uses_template", "puts")
UPSTREAM = ("submits_to", "links_to", "requests")
PROCEDURE = (*UPSTREAM, "maps_to", "dispatches_to", "calls", "calls_procedure", "implements", "implemented_by", "uses_statement", "reads_from", "writes_to")
MODES = {
    "feature": (("page", "route", "java_type", "java_method", "statement", "procedure", "tiles_definition", "table"), "outgoing", (*LINEAGE, *UPSTREAM, "includes", "loads_script")),
    "url": (("route",), "outgoing", LINEAGE),
    "statement": (("statement",), "split", (*LINEAGE, *UPSTREAM)),
    "procedure": (("procedure",), "split", PROCEDURE),
    "table": (("table",), "incoming", (*LINEAGE, *UPSTREAM)),
}


@dataclass
class Trace:
    """Result of a traversal; its size is bounded by the limits."""

    paths: list[dict] = field(default_factory=list)
    nodes: set[str] = field(default_factory=set)
    edges: set[str] = field(default_factory=set)
    expanded: int = 0
    enqueued: int = 0
    state_limit: bool = False
    path_limit: bool = False
    depth_limit: bool = False
    max_states: int = 0
    max_paths: int = 0
    max_depth: int = 0
    matches: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def truncated(self) -> bool:
        return self.state_limit or self.path_limit or self.depth_limit


def steps(edges: DataFrame, direction: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges as steps `at` -> `to`, in the wanted direction."""
    if types:
        edges = edges.where(F.col("type").isin(list(types)))
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), F.col("id").alias("edge"), "type")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), F.col("id").alias("edge"), "type")
    return {"outgoing": out, "incoming": back, "both": out.unionAll(back)}[direction]


def in_order(spark: SparkSession, paths: list[dict]) -> list[dict]:
    """Paths by their number of nodes, longest first, then by their ids in the order of the root locale."""
    if len(paths) < 2:
        return list(paths)
    rows = [(i, len(p["nodes"]), ",".join(p["nodes"])) for i, p in enumerate(paths)]
    ranked = spark.createDataFrame(rows, "i int, n int, ids string").orderBy(F.desc("n"), collated(F.col("ids")), "i")
    return [paths[r["i"]] for r in ranked.select("i").collect()]


def collated(c: Column) -> Column:
    """A text as it sorts in the root locale."""
    return F.collate(c, "UNICODE")


def traverse(edges: DataFrame, start_ids: list[str], direction: str = "outgoing", types: tuple[str, ...] | None = None, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS, max_states: int = MAX_STATES, ends: DataFrame | None = None) -> Trace:
    """Simple paths in breadth-first order from start_ids, neighbours by edge id in the order of the root locale, within the limits.

    The open paths of a level never exceed max_states, so they are what is sent to the edges; the
    edges stay distributed. Of a level's continuations only the first ones that the state limit leaves,
    and one more, come back, in one job a level. ends: ids (column id) at which an outgoing path stops.
    """
    spark = edges.sparkSession
    adjacent = steps(edges, direction, types)
    start_ids = list(dict.fromkeys(start_ids))
    out = Trace(nodes=set(start_ids), max_states=max_states, max_paths=max_paths, max_depth=max_depth)
    level = [{"nodes": [s], "types": [], "edges": []} for s in start_ids]
    stop, out.enqueued = False, len(level)
    while level and not stop:
        deep = len(level[0]["types"]) >= max_depth
        open_ = spark.createDataFrame([(i, p["nodes"][-1], p["nodes"]) for i, p in enumerate(level)], "i int, at string, seen array<string>")
        if ends is not None and direction != "incoming":
            # at most max_states rows
            open_ = open_.join(ends.select(F.col("id").alias("at")).distinct(), "at", "left_anti")
        nexts = adjacent.join(F.broadcast(open_), "at").where(~F.array_contains("seen", F.col("to")))
        found: dict[int, list] = {}
        if deep:
            found = {r["i"]: [r] for r in nexts.select("i").distinct().collect()}
        else:
            for r in nexts.orderBy("i", collated(F.col("edge"))).limit(max(0, max_states - out.enqueued) + 1).select("i", "edge", "type", "to").collect():
                found.setdefault(r["i"], []).append(r)
        after: list[dict] = []
        for i, path in enumerate(level):
            if len(out.paths) >= max_paths:
                out.path_limit, stop = True, True
                break
            out.expanded += 1
            more = found.get(i, [])
            if deep or not more:
                out.depth_limit |= bool(more)
                if len(path["nodes"]) > 1:
                    out.paths.append(path | {"truncated": bool(more)})
                continue
            taken = more[: max(0, max_states - out.enqueued)]
            for r in taken:
                out.nodes.add(r["to"])
                out.edges.add(r["edge"])
                after.append({"nodes": [*path["nodes"], r["to"]], "types": [*path["types"], r["type"]], "edges": [*path["edges"], r["edge"]]})
            out.enqueued += len(taken)
            if len(taken) < len(more):
                out.state_limit, stop = True, True
                waiting = in_order(spark, [p for p in level[i:] + after if len(p["nodes"]) > 1])
                room = max_paths - len(out.paths)
                out.path_limit |= len(waiting) > room
                out.paths += [p | {"truncated": True} for p in waiting[:room]]
                break
        else:
            if len(out.paths) >= max_paths and after:
                out.path_limit, stop = True, True
        level = after
    out.paths = in_order(spark, out.paths)
    return out


def merge(spark: SparkSession, a: Trace, b: Trace) -> Trace:
    """Union of two directions: flags by or, limits by maximum, counters by sum; a path found twice counts once, and all are put in order again."""
    paths = {(tuple(p["nodes"]), tuple(p["edges"])): p for p in [*a.paths, *b.paths]}
    most = {k: max(getattr(a, k), getattr(b, k)) for k in ("max_states", "max_paths", "max_depth")}
    return Trace(in_order(spark, list(paths.values())), a.nodes | b.nodes, a.edges | b.edges, a.expanded + b.expanded, a.enqueued + b.enqueued, a.state_limit or b.state_limit, a.path_limit or b.path_limit, a.depth_limit or b.depth_limit, **most)


def trace(nodes: DataFrame, edges: DataFrame, query: str, mode: str, ascii_only: bool = False) -> Trace:
    """A trace by mode: search in the mode's node types, begin at the best matches, walk the mode's edges, both ways apart for the split modes.

    warnings has no_match, or each limit that was reached (state_limit, path_limit, depth_limit).
    """
    types, direction, kinds = MODES[mode]
    found = [r["id"] for r in search.starts(nodes, query, list(types), ascii_only).collect()]
    if not found:
        return Trace(warnings=["no_match"])
    spark, ends = edges.sparkSession, nodes.where("type = 'table'").select("id")
    if direction == "split":
        out = merge(spark, *(traverse(edges, found, way, kinds, ends=ends) for way in ("incoming", "outgoing")))
    else:
        out = traverse(edges, found, direction, kinds, ends=ends)
    out.matches, out.warnings = found, [w for w in ("state_limit", "path_limit", "depth_limit") if getattr(out, w)]
    return out


def trace_feature(nodes: DataFrame, edges: DataFrame, query: str) -> Trace:
    """From any kind of node onwards."""
    return trace(nodes, edges, query, "feature")


def trace_url(nodes: DataFrame, edges: DataFrame, query: str) -> Trace:
    """From a route onwards."""
    return trace(nodes, edges, query, "url")


def trace_statement(nodes: DataFrame, edges: DataFrame, query: str) -> Trace:
    """From a mapped statement both ways."""
    return trace(nodes, edges, query, "statement")


def trace_procedure(nodes: DataFrame, edges: DataFrame, query: str) -> Trace:
    """From a stored procedure both ways."""
    return trace(nodes, edges, query, "procedure")


def trace_table(nodes: DataFrame, edges: DataFrame, query: str) -> Trace:
    """Back from a table to what leads there."""
    return trace(nodes, edges, query, "table")


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "outgoing", types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, level): all nodes reachable from seeds (column id) with the least number of steps; each round joins only the newest nodes, until there are none."""
    adjacent = steps(edges, direction, types).select("at", "to")
    seen, k = Rounds(seeds.select("id").distinct().withColumn("level", F.lit(0))), 0
    while not seen.last.isEmpty():
        k += 1
        new = seen.last
        seen.add(adjacent.join(new, adjacent["at"] == new["id"]).select(F.col("to").alias("id")).distinct().join(seen.all().select("id"), "id", "left_anti").withColumn("level", F.lit(k)))
    return seen.all()


def nearest(climb: DataFrame, hits: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The hits at the fewest steps up, for each start. Cycles end.

    climb: id, parent; hits: owner, found and perhaps name; starts: id and, with names, name (a hit
    must have the start's name). Without starts every id of climb is one. Gives the start's columns,
    found and level.
    """
    starts = climb.select("id").distinct() if starts is None else starts
    key, named = starts.columns, [c for c in starts.columns if c != "id"]
    up, hits = climb.select(F.col("id").alias("at"), "parent"), hits.withColumnRenamed("owner", "at")
    seen, k = Rounds(starts.distinct().withColumn("at", F.col("id")).withColumn("level", F.lit(0))), 0
    while not seen.last.isEmpty():
        k += 1
        closed = seen.last.join(hits.select("at", *named).distinct(), ["at", *named]).select(*key).distinct()
        higher = seen.last.join(closed, key, "left_anti").join(up, "at").where("parent is not null").select(*key, F.col("parent").alias("at")).distinct()
        seen.add(higher.join(seen.all().select(*key, "at"), [*key, "at"], "left_anti").withColumn("level", F.lit(k)))
    return seen.all().join(hits, ["at", *named]).select(*key, "found", "level")


def contexts(edges: DataFrame, seeds: DataFrame, reset: tuple[str, ...] = ("redirects_to",)) -> DataFrame:
    """(id, route, page): contexts in which a node is arrived at; a resetting edge clears both. seeds has these three columns, '' for none."""
    moves = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "type")
    keep = lambda c: F.when(F.col("type").isin(list(reset)), F.lit("")).otherwise(F.col(c)).alias(c)
    seen = Rounds(seeds.select("id", "route", "page").distinct())
    while not seen.last.isEmpty():
        new = seen.last
        seen.add(moves.join(new, moves["at"] == new["id"]).select(F.col("to").alias("id"), keep("route"), keep("page")).distinct().join(seen.all(), ["id", "route", "page"], "left_anti"))
    return seen.all()


def branch_paths(paths: DataFrame) -> DataFrame:
    """Of ranked paths (rank, nodes) those that first show some node: the paths that greedy selection of unseen branches keeps."""
    first = paths.select("rank", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("rank").alias("rank")).select("rank").distinct()
    return paths.join(first, "rank", "left_semi")


def claims(parents: DataFrame, puts: DataFrame) -> DataFrame:
    """Effective puts of composed definitions: (id, name, value), the nearest definition up the chain wins, then the first in order. parents: id, parent; puts: owner, name, value, ord."""
    ids = puts.select(F.col("owner").alias("id")).union(parents.select("id")).distinct()
    seen, k = Rounds(ids.select("id", F.col("id").alias("at"), F.lit(0).alias("level"))), 0
    while not seen.last.isEmpty():
        k += 1
        up = seen.last.join(parents.select(F.col("id").alias("at"), "parent"), "at").where("parent is not null").select("id", F.col("parent").alias("at")).distinct()
        seen.add(up.join(seen.all().select("id", "at"), ["id", "at"], "left_anti").withColumn("level", F.lit(k)))
    chain = seen.all()
    w = W.partitionBy("id", "name").orderBy("level", "ord")
    return chain.join(puts, chain["at"] == puts["owner"]).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "name", "value")
