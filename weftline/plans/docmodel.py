"""Document model over a graph: use cases of routes, page specifications, modules, technical evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.scratch import cut
from weftline.operators import budget, search, traverse
from weftline.plans.resolve import Graph

# Caps of the model, edge types of a flow, node types that make a branch.
STEPS, ALTERNATES, TRIGGERS, TABLES, USE_CASES, PAGES, ACTIONS, ARRIVALS = 24, 8, 20, 20, 200, 200, 40, 20
FLOW = ("maps_to", "dispatches_to", "forwards_to", "redirects_to", "uses_tile", "calls", "calls_procedure", "implements", "implemented_by", "uses_statement", "reads_from", "writes_to", "extends", "extends_tile", "uses_template", "puts")
TRIGGER = ("submits_to", "links_to", "requests")
BRANCH = ("java_type", "java_method", "page", "route", "tiles_definition", "statement", "procedure", "table")
ARRIVAL = ("forwards_to", "redirects_to", "includes", "uses_tile", "puts", "uses_template")
OUTCOME = ("forwards_to", "redirects_to", "uses_tile")


def flows(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int = 14, max_states: int = 5000, max_paths: int = 100) -> DataFrame:
    """Paths from many starts (id) at once: start, nodes, edges, truncated. The start is part of every state's key, so one round of joins serves all.

    Within a start, states beyond max_states in breadth-first order and paths beyond max_paths are cut,
    with truncated set on the start's rows.
    """
    step = traverse.steps(edges, "outgoing", FLOW).select("at", "to", "edge")
    end_ids = ends.select(F.col("id").alias("at")).distinct().withColumn("ends", F.lit(True))
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("capped"))
    level, done = cut(level), None
    for depth in range(max_depth + 1):
        here = level.join(end_ids, "at", "left")
        more = here.where("ends is null").join(step, "at").where(~F.array_contains("nodes", F.col("to")))
        grown = more.select("start", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), "held", "capped")
        w = W.partitionBy("start").orderBy("edges")
        grown = grown.withColumn("rk", F.row_number().over(w) + F.col("held")).withColumn("capped", F.col("capped") | (F.max("rk").over(W.partitionBy("start")) > max_states)).where(F.col("rk") <= max_states)
        grown = cut(grown.withColumn("held", F.max("rk").over(W.partitionBy("start"))).drop("rk"))
        parents = grown.select("start", F.slice("edges", 1, depth).alias("edges")).distinct()
        ended = here.join(parents, ["start", "edges"], "left_anti").where("size(nodes) > 1").select("start", "nodes", "edges", "capped", F.lit(False).alias("deep"))
        done = cut(ended if done is None else done.unionByName(ended))
        level = grown
        if depth == max_depth or level.isEmpty():
            break
    if depth == max_depth:
        done = done.unionByName(level.select("start", "nodes", "edges", "capped", F.lit(True).alias("deep")))
    order = W.partitionBy("start").orderBy(F.size("nodes").desc(), F.array_join("nodes", ","))
    ranked = done.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("start")))
    return ranked.where(F.col("rank") <= max_paths).select("start", "rank", "nodes", "edges", (F.col("capped") | F.col("deep") | (F.col("n") > max_paths)).alias("truncated"))


@dataclass
class Model:
    use_cases: DataFrame  # route, module, main flow, confidence, tables, statements, triggers
    flows: DataFrame  # alternate flows of each route
    pages: DataFrame
    modules: DataFrame


def executable(graph: Graph) -> DataFrame:
    """Routes that something enters or that lead somewhere."""
    into = graph.edges.where(F.col("type").isin("contains", "redirects_to", "submits_to", "requests")).select(F.col("target").alias("id"))
    out = graph.edges.where(F.col("type").isin(*FLOW)).select(F.col("source").alias("id"))
    return graph.nodes.where("type = 'route'").join(into.union(out).distinct(), "id", "left_semi")


def scope(graph: Graph, query: str) -> DataFrame:
    """Routes (id) of a scope: those of the module of that exact name, else those from which a search match is reached, or that a matching page calls."""
    routes = executable(graph)
    module = routes.where(tx.module_of(F.col("name")) == query).select("id")
    if not module.isEmpty():
        return module
    found = search.scored(graph.nodes, query).select("id", "type")
    up = traverse.reach(graph.edges, found, "incoming", (*FLOW, "includes")).select("id")
    asked = graph.edges.where(F.col("type").isin(*TRIGGER)).join(found.where("type = 'page'").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    return routes.select("id").join(up.union(asked).distinct(), "id", "left_semi")


def via_scripts(edges: DataFrame) -> DataFrame:
    """Requests of pages through the scripts that they load, with the lesser confidence."""
    load = edges.where("type = 'loads_script'").select(F.col("source").alias("page"), F.col("target").alias("script"), F.col("confidence").alias("c1"))
    ask = edges.where("type = 'requests' and source like 'file:%'").select(F.col("source").alias("script"), "target", F.col("confidence").alias("c2"))
    return load.join(ask, "script").groupBy(F.col("page").alias("source"), "target").agg(F.max(F.least("c1", "c2")).alias("confidence")).withColumn("type", F.lit("requests"))


def build(graph: Graph, facts: DataFrame | None = None, scope_query: str | None = None) -> Model:
    """The model of a graph, or of a scope of it. Caps keep the first rows by name; each has a flag."""
    nodes = graph.nodes.select("id", "type", "name", "file_path")
    routes = executable(graph).select("id", "name")
    if scope_query:
        routes = routes.join(scope(graph, scope_query), "id", "left_semi")
    all_routes = routes.count()
    routes = cut(routes.orderBy("name").limit(USE_CASES))
    paths = cut(flows(graph.edges, routes, nodes.where("type = 'table'")))

    conf = graph.edges.select(F.col("id").alias("edge"), "confidence")
    main = paths.where("rank = 1")
    sure = main.select("start", F.explode(F.slice("edges", 1, STEPS - 1)).alias("edge")).join(conf, "edge").groupBy("start").agg(F.min("confidence").alias("confidence"))
    seen = cut(paths.select("start", "rank", F.explode(F.slice("nodes", 2, 1000)).alias("id")).join(nodes.where(F.col("type").isin(*BRANCH)).select("id"), "id", "left_semi"))
    first = seen.groupBy("start", "id").agg(F.min("rank").alias("rank")).where("rank > 1").select("start", "rank").distinct()
    alternates = budget.capped(paths.join(first, ["start", "rank"], "left_semi").withColumnRenamed("rank", "path_rank"), "start", ["path_rank"], ALTERNATES)

    visited = cut(paths.select("start", F.explode("edges").alias("edge")).distinct().join(graph.edges.select(F.col("id").alias("edge"), "type", "target"), "edge"))
    access = visited.where("type in ('reads_from', 'writes_to')").groupBy("start", "target").agg(F.bool_or(F.col("type") == "reads_from").alias("r"), F.bool_or(F.col("type") == "writes_to").alias("w"))
    access = access.join(nodes.select(F.col("id").alias("target"), F.col("name").alias("table")), "target").withColumn("access", tx.access(F.col("r"), F.col("w")))
    tables = budget.capped(access, "start", ["table"], TABLES).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("table", "access"))).alias("tables"), F.bool_or("truncated").alias("tables_truncated"))
    ops = visited.where("type = 'uses_statement'").select("start", F.regexp_replace("target", "^statement:", "").alias("s")).groupBy("start").agg(F.array_sort(F.collect_set("s")).alias("statements"))
    asked = graph.edges.where(F.col("type").isin(*TRIGGER) & F.col("source").startswith("page:")).select("source", "target", "confidence", "type").unionByName(via_scripts(graph.edges).select("source", "target", "confidence", "type"))
    trigger = budget.capped(asked.groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence")), "target", ["source", "type"], TRIGGERS)
    triggers = trigger.groupBy(F.col("target").alias("start")).agg(F.array_sort(F.collect_list(F.struct("source", "type", "confidence"))).alias("triggers"), F.bool_or("truncated").alias("triggers_truncated"))
    outcome = graph.edges.where(F.col("type").isin(*OUTCOME)).groupBy(F.col("source").alias("start")).agg(F.array_sort(F.collect_list(F.struct(F.regexp_replace("reason", "^outcome ", "").alias("name"), "type", "target"))).alias("outcomes"))
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    cases = routes.select(F.col("id").alias("start"), F.col("name").alias("route"), tx.module_of(F.col("name")).alias("module"))
    cases = cases.join(main.select("start", F.slice("nodes", 1, STEPS).alias("main_flow"), (F.col("truncated") | (F.size("nodes") > STEPS)).alias("flow_truncated")), "start", "left")
    for part in (sure, tables, ops, triggers, outcome):
        cases = cases.join(part, "start", "left")
    cases = cut(cases.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "main_flow": F.coalesce("main_flow", F.array("start")), "flow_truncated": F.coalesce("flow_truncated", F.lit(False)), "statements": none(F.col("statements"), "array<string>"), "use_cases_truncated": F.lit(all_routes > USE_CASES)}))

    on_page = asked.select(F.col("source").alias("id"), F.col("target").alias("route")).distinct()
    arrive = graph.edges.where(F.col("type").isin(*ARRIVAL) & F.col("target").startswith("page:")).select(F.col("target").alias("id"), F.col("source").alias("route")).distinct()
    acts = budget.capped(on_page, "id", ["route"], ACTIONS).groupBy("id").agg(F.array_sort(F.collect_list("route")).alias("actions"))
    comes = budget.capped(arrive, "id", ["route"], ARRIVALS).groupBy("id").agg(F.array_sort(F.collect_list("route")).alias("arrivals"))
    pages = nodes.where("type = 'page'").join(acts, "id", "left").join(comes, "id", "left").orderBy("name").limit(PAGES)
    if facts is not None:
        f = facts.where("kind = 'field'").select(F.concat(F.lit("page:"), tx.web_path(F.col("path"))).alias("id"), F.col("data")["name"].alias("name"), F.col("data")["type"].alias("type"), F.col("data")["default"].alias("d"))
        one = f.groupBy("id", "name").agg(F.min("type").alias("type"), F.when((F.count_distinct("d") == 1) & (F.count("d") == F.count(F.lit(1))), F.min("d")).otherwise("").alias("default"))
        pages = pages.join(one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "type", "default"))).alias("fields")), "id", "left")
    modules = cases.groupBy("module").agg(F.count(F.lit(1)).alias("use_cases"), F.array_sort(F.collect_list("route")).alias("routes"))
    return Model(cases, alternates, cut(pages), modules)


def matrix(model: Model) -> DataFrame:
    """(module, table, route, access) of all use cases."""
    return model.use_cases.select("module", "route", F.explode("tables").alias("t")).select("module", "t.table", "route", "t.access")


def technical_evidence(graph: Graph, query: str, per_type: int = 8, starts: int = 64) -> dict:
    """Nodes and edges around the best matches of each type, both ways, with the files they stand in."""
    found = search.per_type(graph.nodes, query, per_type).orderBy(F.desc("score"), "id").limit(starts)
    ids = [r["id"] for r in found.select("id").collect()]
    types = (*FLOW, *TRIGGER, "includes", "loads_script", "declares", "implements")
    both = traverse.merge(graph.nodes.sparkSession, *(traverse.traverse(graph.edges, ids, way, types, 20, 200, 10_000) for way in ("outgoing", "incoming"))) if ids else traverse.Trace()
    spark = graph.nodes.sparkSession
    keep = lambda df, found: df.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(found)] or [("",)], "id string")), "id", "left_semi")  # noqa: E731  bounded by the traversal's limits
    nodes, edges = keep(graph.nodes, both.nodes), keep(graph.edges, both.edges)
    files = nodes.select(F.explode("evidence.file").alias("file")).union(edges.select(F.explode("evidence.file"))).distinct().orderBy("file")
    return {"matches": found, "nodes": nodes, "edges": edges, "files": files, "trace": both}


# Headings that a technical document must have once each, and the mark of a section without proof.
HEADINGS = (
    "## 1. Overview",
    "## 2. Workflow Stages",
    "## 3. Database Tables",
    "## 4. Class Architecture",
    "## 5. Data Flow",
    "## 6. Business Rules",
    "## 7. Error Messages and Lookups",
    "## 8. Evidence Gaps",
)
OPEN_MARK = "Needs verification"
_CITED = re.compile(r"`([^`\n]+?):([0-9]+)`|(?<![\w./-])([\w./-]*[\w-]\.\w+):([0-9]+)")


def shown_lines(text: str) -> list[str]:
    """Lines outside fenced code; fence lines and what they hold are empty."""
    out, fence = [], ""
    for line in re.split(r"\r\n|\r|\n", text):
        mark = (m := re.match(r" {0,3}(`{3,}|~{3,})", line)) and m[1] or ""
        inside = bool(fence)
        if not fence:
            fence = mark
        elif mark[:1] == fence[0] and len(mark) >= len(fence) and not line.strip().strip(fence[0]):
            fence = ""
        out.append("" if inside or mark else line)
    return out


def cited(text: str) -> list[tuple[str, int]]:
    """(path, line) of all citations, in back-ticks or bare, in order; none is found twice at a place."""
    return [(m[1] or m[3], int(m[2] or m[4])) for m in _CITED.finditer(text)]


def check_document(text: str, line_counts: dict[str, int], allowed: set[str] | None = None) -> list[str]:
    """What is wrong with a written document: headings that miss or repeat, sections without a citation or the mark, no citation at all, citations of unsafe, unknown or other files, lines that a file does not have. Fenced code counts for nothing."""
    lines, out = shown_lines(text), []
    for h in HEADINGS:
        at = [i for i, line in enumerate(lines) if line == h]
        if len(at) != 1:
            out.append(f"heading {h}: {len(at)} times")
        if at:
            end = next((i for i in range(at[0] + 1, len(lines)) if re.match(r"##\s", lines[i])), len(lines))
            body = "\n".join(lines[at[0] + 1 : end])
            if not cited(body) and not re.search(rf"\b{OPEN_MARK}\b", body):
                out.append(f"section {h}: no citation")
    found = cited("\n".join(lines))
    if not found:
        out.append("no citation")
    for path, line in found:
        if path.startswith("/") or "\\" in path or re.match("[A-Za-z]:", path) or ".." in path.split("/"):
            out.append(f"unsafe path {path}")
        elif allowed is not None and path not in allowed:
            out.append(f"file outside the evidence {path}")
        elif path not in line_counts:
            out.append(f"unknown file {path}")
        elif not 1 <= line <= line_counts[path]:
            out.append(f"line {line} beyond {path}")
    return out
