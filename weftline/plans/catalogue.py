"""Registered queries of the lineage engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.scratch import cut
from weftline.operators import budget, match, merge, search, traverse
from weftline.plans import star
from weftline.sources.parsers import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(c):
    return F.count(F.lit(1)).cast("long").alias(c)


# --- graph summaries, merging, integrity


@query(f"{star.WITH} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def graph_node_summary(spark, d):
    return merge.type_counts(star.nodes(spark, d))


@query(f"{star.WITH} SELECT type, count(*) AS n FROM edges GROUP BY type")
def graph_edge_summary(spark, d):
    return merge.type_counts(star.edges(spark, d))


@query(f"""{star.WITH} SELECT (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.source) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.target)) AS orphans,
  (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)) AS node_repeats, (SELECT count(*) FROM (SELECT id FROM edges GROUP BY id HAVING count(*) > 1)) AS edge_repeats""")
def graph_integrity(spark, d):
    return merge.integrity(star.nodes(spark, d), star.edges(spark, d))


@query("SELECT l_partkey, l_suppkey, CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) AS first_line FROM lineitem GROUP BY l_partkey, l_suppkey")
def edge_first_wins(spark, d):
    rows = star.read(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return merge.first_wins(rows.withColumn("first_line", F.col("ord")), ["l_partkey", "l_suppkey"], ["ord"]).select("l_partkey", "l_suppkey", "first_line")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def node_last_wins(spark, d):
    return merge.last_wins(star.read(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT id, name, path, array_to_string(kinds, ',') AS kinds FROM (
  SELECT 'part:' || CAST(l_partkey AS VARCHAR) AS id, arg_min(l_returnflag, ord) AS name, arg_min(l_linestatus, CASE WHEN l_quantity > 25 THEN ord END) AS path, list(l_returnflag ORDER BY ord) AS k FROM (SELECT *, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY l_partkey) t,
  LATERAL (SELECT list(x ORDER BY p) AS kinds FROM (SELECT x, min(p) AS p FROM (SELECT unnest(t.k) AS x, generate_subscripts(t.k, 1) AS p) GROUP BY x)) u""")
def node_merge(spark, d):
    rows = star.read_placed(spark, d, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), F.lit("part").alias("type"), F.col("l_returnflag").alias("name"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("file_path"),
        F.array("l_returnflag").alias("evidence"), F.array("l_returnflag").alias("search_text"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("data"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "file", "row",
    )
    return merge.merge_nodes(rows, then=("file", "row")).select("id", "name", F.col("file_path").alias("path"), F.array_join("search_text", ",").alias("kinds"))


@query("SELECT l_orderkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY o, p) AS parts FROM (SELECT l_orderkey, l_partkey AS p, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def ordered_evidence_merge(spark, d):
    return star.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(merge.ordered_union(F.array(F.col("l_partkey").cast("string")), F.struct("l_linenumber", "l_partkey")), ",").alias("parts"))


# --- search


def _score_sql(term: str) -> str:
    words = term.split()
    every = " AND ".join(f"contains(lower(name), '{w}')" for w in words)
    return f"""CASE WHEN lower(name) = '{term}' THEN 1000 WHEN lower(id) = '{term}' OR lower(id) LIKE '%:{term}' THEN 950 WHEN contains(lower(name), '{term}') THEN 850
      WHEN contains(lower(id), '{term}') THEN 800 WHEN ({every}) THEN 500 ELSE 0 END"""


@query(f"{star.WITH} SELECT id, type, CAST(score AS INTEGER) AS score FROM (SELECT id, type, {_score_sql('supplier')} AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, icu_sort_key(id, 'en') LIMIT 25")
def search_nodes_topk(spark, d):
    return search.search(star.nodes(spark, d), "Supplier", ascii_only=True).select("id", "type", "score")


@query(f"{star.WITH} SELECT id, type, CAST(score AS INTEGER) AS score FROM (SELECT id, type, {_score_sql('42')} AS score FROM nodes WHERE type IN ('part', 'customer')) WHERE score > 0 ORDER BY score DESC, icu_sort_key(id, 'en') LIMIT 25")
def search_typed_topk(spark, d):
    return search.search(star.nodes(spark, d), " 42 ", types=["part", "customer"], ascii_only=True).select("id", "type", "score")


@query(f"""{star.WITH}, s AS (SELECT id, type, {_score_sql('1')} AS score FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, icu_sort_key(id, 'en')) AS rank, count(*) OVER (PARTITION BY type) AS n FROM s WHERE score > 0)
  SELECT id, type, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank, n > 8 AS truncated FROM r WHERE rank <= 8""")
def search_per_type_topk(spark, d):
    return search.per_type(star.nodes(spark, d), "1", ascii_only=True).select("id", "type", "score", "rank", "truncated")


@query(f"""{star.WITH}, s AS (SELECT id, {_score_sql('1')} AS score FROM nodes), t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, icu_sort_key(id, 'en') LIMIT 10)
  SELECT id, CAST(score AS INTEGER) AS score FROM t WHERE score = (SELECT max(score) FROM t) ORDER BY icu_sort_key(id, 'en') LIMIT 5""")
def trace_starts(spark, d):
    return search.starts(star.nodes(spark, d), "1", ascii_only=True).select("id", "score")


# --- traversal

_ALL = ("in_nation", "in_region", "placed_by", "contains", "supplied_by")
_UP = ("in_nation", "in_region", "supplied_by")


def _edges(spark, d, kinds=None):
    """The star graph's edges, built once for the rounds of a traversal."""
    return cut(star.edges(spark, d, kinds))


def _trace(spark, d, start, direction, kinds, depth, paths, states):
    return traverse.traverse(_edges(spark, d, kinds), [start], direction, None, depth, paths, states)


def _trace_sql(start, direction, kinds, depth, paths, states, select, tags=("t",)):
    ways = {"t": direction, "a": "incoming", "b": "outgoing"}
    parts = [star.trace_sql(star.edges_sql(kinds), f"SELECT '{start}' AS id, 0 AS idx", ways[t], depth, paths, states, t) for t in tags]
    return f"WITH RECURSIVE {', '.join(parts)} {select(*tags)}"


def _path_rows(t):
    return [(" > ".join(p["nodes"]), len(p["edges"]), bool(p.get("truncated"))) for p in t.paths]


def _paths(spark, t):
    return spark.createDataFrame(_path_rows(t), "path string, steps int, truncated boolean")


def _stats(spark, t):
    return spark.createDataFrame([(t.expanded, t.enqueued, t.state_limit, t.path_limit, t.depth_limit)], "expanded long, enqueued long, state_limit boolean, path_limit boolean, depth_limit boolean")


def _report(spark, t):
    """A trace as rows: its paths, counters and warnings."""
    rows = [("path", *r) for r in _path_rows(t)]
    if t.matches:
        rows += [("expanded", "", t.expanded, False), ("enqueued", "", t.enqueued, False)]
    return spark.createDataFrame([*rows, *(("warning", w, 0, False) for w in t.warnings)], "what string, value string, steps int, truncated boolean")


def _start_order(spark, d) -> str:
    """The least order of the table: a start that each scale has."""
    return "order:" + str(star.read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing lineage of the least order: to its customer, parts, suppliers, nations and regions."""
    return _paths(spark, _trace(spark, sf_dir, _start_order(spark, sf_dir), "outgoing", _ALL, 14, 100, 5000))


@query(_trace_sql("order:1", "outgoing", _ALL, 14, 100, 5000, star.paths_sql))
def trace_outgoing(spark, d):
    return _paths(spark, _trace(spark, d, "order:1", "outgoing", _ALL, 14, 100, 5000))


@query(_trace_sql("part:1", "incoming", _ALL, 14, 100, 5000, star.paths_sql))
def trace_incoming(spark, d):
    return _paths(spark, _trace(spark, d, "part:1", "incoming", _ALL, 14, 100, 5000))


@query(_trace_sql("nation:1", "incoming", _UP, 14, 100000, 700, star.counters_sql))
def trace_state_cap(spark, d):
    return _stats(spark, _trace(spark, d, "nation:1", "incoming", _UP, 14, 100000, 700))


@query(_trace_sql("nation:1", "incoming", _UP, 14, 40, 100000, star.counters_sql))
def trace_path_cap(spark, d):
    return _stats(spark, _trace(spark, d, "nation:1", "incoming", _UP, 14, 40, 100000))


@query(_trace_sql("region:1", "incoming", _UP, 2, 100000, 100000, star.counters_sql))
def trace_depth_cap(spark, d):
    return _stats(spark, _trace(spark, d, "region:1", "incoming", _UP, 2, 100000, 100000))


@query(_trace_sql("nation:3", "split", _UP, 14, 100, 5000, star.trace_report_sql, ("a", "b")))
def trace_split(spark, d):
    """Both directions apart, merged: paths once and in order, flags by or, counters by sum."""
    e = _edges(spark, d, _UP)
    t = traverse.merge(spark, *(traverse.traverse(e, ["nation:3"], way) for way in ("incoming", "outgoing")))
    t.matches, t.warnings = ["nation:3"], [w for w in ("state_limit", "path_limit", "depth_limit") if getattr(t, w)]
    return _report(spark, t)


def _mode_sql(mode, term):
    types, direction, kinds = traverse.MODES[mode]
    listed = ", ".join(f"'{x}'" for x in types)
    own = f"""app_nodes AS ({star.nodes_sql(star.APP_NODES)}), hits AS (SELECT id, {_score_sql(term.lower())} AS score FROM app_nodes WHERE type IN ({listed})),
    top AS (SELECT * FROM hits WHERE score > 0 ORDER BY score DESC, icu_sort_key(id, 'en') LIMIT 10),
    first AS (SELECT id, row_number() OVER (ORDER BY icu_sort_key(id, 'en')) AS idx FROM top WHERE score = (SELECT max(score) FROM top) ORDER BY icu_sort_key(id, 'en') LIMIT 5)"""
    ways = {"split": {"a": "incoming", "b": "outgoing"}}.get(direction, {"t": direction})
    edges = star.edges_sql(kinds, star.APP_EDGES)
    parts = [star.trace_sql(edges, "SELECT id, idx FROM first", way, traverse.MAX_DEPTH, traverse.MAX_PATHS, traverse.MAX_STATES, tag) for tag, way in ways.items()]
    return f"WITH RECURSIVE {own}, {', '.join(parts)} {star.trace_report_sql(*ways)}"


def _mode(spark, d, mode, term):
    nodes, edges = star.app(spark, d)
    return _report(spark, traverse.trace(nodes, cut(edges), term, mode, ascii_only=True))


@query(_mode_sql("feature", "Customer#000000011"))
def trace_feature(spark, d):
    return _mode(spark, d, "feature", "Customer#000000011")


@query(_mode_sql("url", "route:1"))
def trace_url(spark, d):
    return _mode(spark, d, "url", "route:1")


@query(_mode_sql("statement", "statement:7"))
def trace_statement(spark, d):
    return _mode(spark, d, "statement", "statement:7")


@query(_mode_sql("procedure", "procedure:4"))
def trace_procedure(spark, d):
    return _mode(spark, d, "procedure", "procedure:4")


@query(_mode_sql("table", "table:2"))
def trace_table(spark, d):
    return _mode(spark, d, "table", "table:2")


@query("SELECT 'warning' AS what, 'no_match' AS value, 0 AS steps, false AS truncated")
def trace_no_match(spark, d):
    return _mode(spark, d, "table", "no such thing")


@query(f"WITH RECURSIVE edges AS ({star.edges_sql()}), r AS (SELECT 'supplier:1' AS id, 0 AS level UNION SELECT e.source, r.level + 1 FROM r JOIN edges e ON e.target = r.id) SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id")
def reachability_reverse(spark, d):
    return traverse.reach(_edges(spark, d), spark.createDataFrame([("supplier:1",)], "id string"), "incoming")


@query(f"WITH RECURSIVE edges AS ({star.edges_sql()}), r AS (SELECT 'order:1' AS id, 0 AS level UNION SELECT e.target, r.level + 1 FROM r JOIN edges e ON e.source = r.id) SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id")
def reachability_forward(spark, d):
    return traverse.reach(_edges(spark, d), spark.createDataFrame([("order:1",)], "id string"), "outgoing")


@query("""WITH paths AS (SELECT l_orderkey, l_linenumber AS rank, [l_partkey, l_suppkey] AS nodes FROM lineitem), f AS (SELECT l_orderkey, node, min(rank) AS rank FROM (SELECT l_orderkey, rank, unnest(nodes) AS node FROM paths) GROUP BY 1, 2)
  SELECT p.l_orderkey, p.rank FROM paths p WHERE EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = p.l_orderkey AND f.rank = p.rank)""")
def alternate_branches(spark, d):
    li = star.read(spark, d, "lineitem")
    rows = li.select(F.struct("l_orderkey", "l_linenumber").alias("rank"), F.array(*(F.struct("l_orderkey", F.col(c).alias("node")) for c in ("l_partkey", "l_suppkey"))).alias("nodes"))
    return traverse.branch_paths(rows).select("rank.l_orderkey", F.col("rank.l_linenumber").alias("rank"))


@query("""SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal > 5000 THEN c_mktsegment WHEN n_nationkey % 2 = 0 THEN n_name WHEN r_regionkey % 2 = 1 THEN r_name END AS found,
  CAST(CASE WHEN c_acctbal > 5000 THEN 0 WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_acctbal > 5000 OR n_nationkey % 2 = 0 OR r_regionkey % 2 = 1""")
def inheritance_nearest_hit(spark, d):
    r = lambda t: star.read(spark, d, t)
    c, n, g = r("customer"), r("nation"), r("region")
    e = _edges(spark, d, ("in_nation", "in_region")).where("source not like 'supplier:%'")
    climb = e.select(F.col("source").alias("id"), F.col("target").alias("parent"))
    hits = c.where("c_acctbal > 5000").select(star._id("customer", "c_custkey").alias("owner"), F.col("c_mktsegment").alias("found")).unionByName(n.where("n_nationkey % 2 = 0").select(star._id("nation", "n_nationkey").alias("owner"), F.col("n_name").alias("found"))).unionByName(g.where("r_regionkey % 2 = 1").select(star._id("region", "r_regionkey").alias("owner"), F.col("r_name").alias("found")))
    return traverse.nearest(climb, hits).where("id like 'customer:%'")


@query("""SELECT DISTINCT id, route, page FROM (
  SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS id, 'supplier:' || CAST(s_suppkey AS VARCHAR) AS route, 'p' AS page FROM supplier
  UNION ALL SELECT 'nation:' || CAST(s_nationkey AS VARCHAR), 'supplier:' || CAST(s_suppkey AS VARCHAR), 'p' FROM supplier
  UNION ALL SELECT 'region:' || CAST(n_regionkey AS VARCHAR), '', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def context_propagation(spark, d):
    e = _edges(spark, d, ("in_nation", "in_region"))
    seeds = star.read(spark, d, "supplier").select(star._id("supplier", "s_suppkey").alias("id"), star._id("supplier", "s_suppkey").alias("route"), F.lit("p").alias("page"))
    return traverse.contexts(e, seeds, ("in_region",))


@query("""WITH RECURSIVE parents AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey - 1 END AS parent FROM part), puts AS (SELECT p_partkey AS owner, unnest(['size' || CAST(p_size % 7 AS VARCHAR), 'brand']) AS name, p_name AS value FROM part),
  up AS (SELECT id, id AS at, 0 AS level FROM parents UNION ALL SELECT up.id, p.parent, up.level + 1 FROM up JOIN parents p ON p.id = up.at WHERE p.parent IS NOT NULL AND EXISTS (SELECT 1 FROM parents q WHERE q.id = p.parent)),
  r AS (SELECT up.id, puts.name, puts.value, row_number() OVER (PARTITION BY up.id, puts.name ORDER BY up.level) AS rn FROM up JOIN puts ON puts.owner = up.at) SELECT id, name, value FROM r WHERE rn = 1""")
def tile_claims(spark, d):
    p = star.read(spark, d, "part")
    parents = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") - 1).alias("parent"))
    puts = p.select(F.col("p_partkey").alias("owner"), F.explode(F.array(F.concat(F.lit("size"), (F.col("p_size") % 7).cast("string")), F.lit("brand"))).alias("name"), F.col("p_name").alias("value"), F.lit(0).alias("ord"))
    return traverse.claims(parents, puts)


# --- resolution joins


@query("""WITH r AS (SELECT p_partkey AS ref, p_name, p_brand FROM part), t AS (SELECT ref, 0 AS tier, 'supplier:' || CAST(s_suppkey AS VARCHAR) AS target FROM r JOIN supplier ON s_suppkey = ref
  UNION ALL SELECT r.ref, 1, 'part:' || CAST(q.p_partkey AS VARCHAR) FROM r JOIN part q ON q.p_name = r.p_name AND q.p_partkey <> r.ref UNION ALL SELECT r.ref, 2, 'brand:' || r.p_brand FROM r)
  SELECT ref, target, CAST(tier AS INTEGER) AS tier FROM (SELECT *, rank() OVER (PARTITION BY ref ORDER BY tier) AS rk FROM t) WHERE rk = 1""")
def tiered_name_resolution(spark, d):
    p = star.read(spark, d, "part")
    refs = p.select(F.col("p_partkey").alias("ref"), "p_name", "p_brand")
    full = refs.join(star.read(spark, d, "supplier"), F.col("s_suppkey") == F.col("ref")).select("ref", star._id("supplier", "s_suppkey").alias("target"))
    known = p.select("p_name", F.col("p_partkey").alias("self"), star._id("part", "p_partkey").alias("target"))
    return match.tiered("ref", [full, (refs.select("ref", "p_name"), known.where("self is not null"), "p_name"), refs.select("ref", F.concat(F.lit("brand:"), "p_brand").alias("target"))])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def unresolved_warnings(spark, d):
    urgent = star.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return match.missing(star.read(spark, d, "customer").select("c_custkey", "c_name"), urgent, "c_custkey")


@query("SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS n, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS value FROM lineitem GROUP BY l_partkey")
def unique_or_ambiguous(spark, d):
    return match.unique_or_ambiguous(star.read(spark, d, "lineitem").withColumnRenamed("l_partkey", "key"), "key", "l_suppkey")


@query("""SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts) AS last_click FROM events e WHERE e.event_type <> 'click'""")
def asof_last_event(spark, d):
    e = star.read(spark, d, "events")
    left = e.where("event_type <> 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("ts").alias("last_click"))
    return match.as_of(left, right, ["user_id"], "ts", "click_ts", ["last_click"]).select("event_id", "last_click")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS lo, CAST(l_linenumber + l_quantity AS INTEGER) AS hi FROM lineitem), p AS (SELECT o_orderkey AS l_orderkey, CAST(o_orderkey % 30 AS INTEGER) AS point FROM orders)
  SELECT l_orderkey, point, l_linenumber FROM (SELECT p.l_orderkey, p.point, r.l_linenumber, row_number() OVER (PARTITION BY p.l_orderkey, p.point ORDER BY r.hi - r.lo, r.l_linenumber) AS rn FROM p JOIN r ON r.l_orderkey = p.l_orderkey AND p.point >= r.lo AND p.point < r.hi) WHERE rn = 1""")
def innermost_range(spark, d):
    ranges = star.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("hi"))
    points = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 30).cast("int").alias("point"))
    return match.innermost(points, ranges, ["l_orderkey"], "point", "lo", "hi", "l_linenumber").select("l_orderkey", "point", "l_linenumber")


_PATH = r"regexp_replace(url, '^[a-z]+://[^/]+|[?#].*$', '', 'g')"
_SEGMENT = f"regexp_extract({_PATH}, '^(/[^/]*)', 1)"


@query(f"""WITH u AS (SELECT page_id, {_PATH} AS url FROM pages), pat AS (SELECT DISTINCT {_SEGMENT} || '/*' AS pattern FROM pages UNION SELECT DISTINCT {_PATH} FROM pages)
  SELECT page_id, url, pattern FROM u JOIN pat ON url = pattern UNION SELECT page_id, url, pattern FROM u JOIN (SELECT pattern FROM pat WHERE ends_with(pattern, '/*')) ON starts_with(url, left(pattern, length(pattern) - 1))""")
def prefix_route_match(spark, d):
    p = star.read(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]+|[?#].*$", "").alias("url"))
    patterns = p.select(F.concat(F.regexp_extract("url", "^(/[^/]*)", 1), F.lit("/*")).alias("pattern")).union(p.select("url")).distinct()
    return match.prefix_routes(p, patterns)


@query("""SELECT o_orderkey, CASE WHEN count(*) = 1 AND count(DISTINCT l_suppkey) = 1 AND bool_and(l_returnflag = 'N') THEN 'code-confirmed' ELSE 'configured-candidate' END AS classification FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def classify_confirmed(spark, d):
    rows = star.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("s"), F.bool_and(F.col("l_returnflag") == "N").alias("k"))
    ok = (F.col("n") == 1) & (F.col("s") == 1) & F.col("k")
    return star.read(spark, d, "orders").select("o_orderkey").join(rows, "o_orderkey").select("o_orderkey", F.when(ok, "code-confirmed").otherwise("configured-candidate").alias("classification"))


# --- document-model aggregates


@query("""SELECT l_suppkey, l_partkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') THEN 'read-write' WHEN bool_or(l_returnflag <> 'R') THEN 'write' ELSE 'read' END AS access FROM lineitem GROUP BY 1, 2""")
def access_pivot(spark, d):
    return star.read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(tx.access(F.bool_or(F.col("l_returnflag") == "R"), F.bool_or(F.col("l_returnflag") != "R")).alias("access"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey")
def access_matrix(spark, d):
    out = star.read(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return out.select("l_suppkey", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")))


@query(f"""WITH m AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS p FROM pages) SELECT CASE WHEN len(p) >= 2 THEN p[1] ELSE 'root' END AS module, count(*) AS pages, min(page_id) AS first_page FROM m GROUP BY 1""")
def module_rollup(spark, d):
    url = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    return star.read(spark, d, "pages").groupBy(tx.module_of(url).alias("module")).agg(_long("pages"), F.min("page_id").alias("first_page"))


@query("SELECT l_orderkey, min(least(1.0 - l_discount, 1.0 - l_tax)) AS confidence FROM lineitem GROUP BY l_orderkey")
def path_min_confidence(spark, d):
    return star.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.least(1.0 - F.col("l_discount"), 1.0 - F.col("l_tax"))).alias("confidence"))


@query("SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def via_two_hop(spark, d):
    return star.read(spark, d, "orders").select("o_orderkey", "o_custkey").join(star.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").select("o_custkey", "l_suppkey").distinct()


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS methods, bool_or(value > 50) AS is_open FROM events GROUP BY user_id")
def hint_summary(spark, d):
    return star.read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("methods"), F.bool_or(F.col("value") > 50).alias("is_open"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(o_orderpriority) = count(*) THEN min(o_orderpriority) ELSE '' END AS value FROM orders GROUP BY o_custkey")
def default_consensus(spark, d):
    one = (F.count_distinct("o_orderpriority") == 1) & (F.count("o_orderpriority") == F.count(F.lit(1)))
    return star.read(spark, d, "orders").groupBy("o_custkey").agg(F.when(one, F.min("o_orderpriority")).otherwise("").alias("value"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'view') THEN NULL ELSE string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS fields FROM events GROUP BY user_id")
def inputs_scope(spark, d):
    return star.read(spark, d, "events").groupBy("user_id").agg(F.when(~F.bool_or(F.col("event_type") == "view"), F.array_join(F.array_sort(F.collect_set("event_type")), ",")).alias("fields"))


@query(r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM q WHERE q <> '')
  SELECT page_id, regexp_extract(kv, '^([^=]*)', 1) AS name, CASE WHEN count(DISTINCT regexp_replace(kv, '^[^=]*=?', '')) = 1 THEN min(regexp_replace(kv, '^[^=]*=?', '')) ELSE '' END AS value FROM p WHERE regexp_extract(kv, '^([^=]*)', 1) <> '' GROUP BY 1, 2""")
def param_merge_conflict(spark, d):
    return star.read(spark, d, "pages").select("page_id", F.explode(tx.query_params(F.col("url"))).alias("name", "value"))


# --- pages and SQL text


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, d):
    return star.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href\s*=\s*"([^"]*)"'), F.lit(1))).alias("href"))


_VISIBLE = r"(?s)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]+>"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '{_VISIBLE}', ' ', 'g'), '\\s+', ' ', 'g')) AS visible FROM pages")
def html_visible_text(spark, d):
    return star.read(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", _VISIBLE, " "), r"\s+", " ")).alias("visible"))


# Fields put before each page, and what is read of them: name, type, default, URL of the form.
_FORM = """<form id="f" action="/save.do?x=1" method="post"><input name="a%s" value="v&amp;1"/><select name="s"><option>q</option></select><textarea name=t></textarea><input type="checkbox" name="c" disabled/></form><!-- <input name="no"/> --><input form="f" name="late"/><input name="loose" type="hidden" value="${x}"/>"""
_FIELDS = (("concat('a', CAST(page_id AS VARCHAR))", "input", "v&1", "/save.do"), ("'s'", "select", "", "/save.do"), ("'t'", "textarea", "", "/save.do"), ("'c'", "checkbox", "", "/save.do"), ("'late'", "input", "", "/save.do"), ("'loose'", "hidden", "", ""))


@query(" UNION ALL ".join(f"SELECT page_id, {n} AS name, '{t}' AS type, '{v}' AS value, '{u}' AS url FROM pages" for n, t, v, u in _FIELDS))
def html_fields(spark, d):
    def fields(batches):
        for b in batches:
            rows = [(i, f[5]["name"], f[5]["type"], f[5]["default"], f[5]["url"]) for i, html in zip(b["page_id"], b["html"], strict=True) for f in web.parse((_FORM % i) + (html or "")).rows if f[0] == "field"]
            yield pd.DataFrame(rows, columns=["page_id", "name", "type", "value", "url"])

    return star.read(spark, d, "pages").select("page_id", "html").mapInPandas(fields, "page_id long, name string, type string, value string, url string")


@query(f"""SELECT page_id, CASE WHEN contains({_PATH}, 'web/') THEN '/' || regexp_replace(split_part({_PATH}, 'web/', 2), '^/+', '') ELSE '/' || regexp_replace({_PATH}, '^/+', '') END AS path FROM pages""")
def web_path(spark, d):
    return star.read(spark, d, "pages").select("page_id", tx.web_path(F.regexp_replace("url", r"^[a-z]+://[^/]+|[?#].*$", "")).alias("path"))


_BASE = "regexp_replace(url, '^[a-z]+://[^/]+|[?#].*$', '', 'g')"
_JOINED = "CASE WHEN path = '' THEN base WHEN starts_with(path, '/') THEN path ELSE regexp_replace(base, '[^/]*$', '') || path END"
_FOLD = "list_reduce(list_prepend('', string_split(joined, '/')), lambda done, s: CASE WHEN s = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN s IN ('', '.') THEN done ELSE done || '/' || s END)"


@query(rf"""WITH l AS (SELECT page_id, {_BASE} AS base, unnest(regexp_extract_all(html, '<a\s[^>]*href\s*=\s*"([^"]*)"', 1)) AS href FROM pages),
  more AS (SELECT page_id, base, unnest(['', '../up', './x/../y/', '..', '?q=1', '#top', '//far/away', 'mailto:a@b', 'a/./b//c/']) AS href FROM (SELECT page_id, {_BASE} AS base FROM pages)),
  p AS (SELECT *, regexp_extract(trim(href), '^[^?#]*') AS path FROM (SELECT * FROM l UNION ALL SELECT * FROM more)), j AS (SELECT *, {_JOINED} AS joined FROM p), f AS (SELECT *, {_FOLD} AS folded FROM j)
  SELECT DISTINCT page_id, href, CASE WHEN starts_with(trim(href), '#') OR starts_with(trim(href), '//') OR regexp_matches(trim(href), '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(path, '[<>]') THEN NULL
    ELSE CASE WHEN folded = '' THEN '/' ELSE folded END || CASE WHEN folded <> '' AND regexp_matches(joined, '(^|/)\.?\.?$') THEN '/' ELSE '' END END AS target FROM f""".replace(r"\s", r"\s"))
def url_resolve(spark, d):
    base = star.read(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]+|[?#].*$", "").alias("base"))
    more = base.select("page_id", F.explode(F.array(*(F.lit(x) for x in ("", "../up", "./x/../y/", "..", "?q=1", "#top", "//far/away", "mailto:a@b", "a/./b//c/")))).alias("href"))
    links = QUERIES["html_links"](spark, d).unionByName(more).join(base, "page_id")
    return links.select("page_id", "href", tx.url_resolved(F.col("base"), F.col("href")).alias("target")).distinct()


# Statements of each kind over the parts: kind, text, tables written and read ({n}: the part's key, {k}: its size).
_STATEMENTS = (
    ("update", "UPDATE x SET a = 1 FROM [Dbo] . Orders{k} x JOIN log.l{k} y ON y.id = x.id -- FROM no{n}", "dbo.orders{k}", "log.l{k}"),
    ("insert", "INSERT INTO t{n} SELECT * FROM s{k} WHERE y = ''FROM no'' /* JOIN no */", "t{n}", "s{k}"),
    ("delete", "DELETE q FROM big.t{k} AS q INNER JOIN r{n} ON 1 = 1", "big.t{k}", "r{n}"),
    ("select", "WITH c AS (SELECT * FROM a{n}) SELECT * FROM c JOIN b{k} z ON 1 = 1", "", "a{n},b{k}"),
    ("update", "MERGE INTO m{k} USING u{n} s ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1", "m{k}", "u{n}"),
    ("statement", "DELETE FROM d{n}; UPDATE e{k} SET x = 1; INSERT INTO f{n} SELECT * FROM g{k}", "d{n},e{k},f{n}", "g{k}"),
)


def _by_part(column: int) -> str:
    whens = " ".join(f"WHEN {i} THEN replace(replace('{s[column]}', '{{n}}', CAST(p_partkey AS VARCHAR(20))), '{{k}}', CAST(p_size AS VARCHAR(20)))" for i, s in enumerate(_STATEMENTS))
    return f"CASE p_partkey % {len(_STATEMENTS)} {whens} END"


@query(f"SELECT p_partkey, {_by_part(2)} AS writes, {_by_part(3)} AS reads FROM part")
def sql_table_lineage(spark, d):
    n, k = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    filled = lambda text: F.replace(F.replace(F.lit(text.replace("''", "'")), F.lit("{n}"), n), F.lit("{k}"), k)
    by_part = lambda c: F.coalesce(*(F.when(F.col("p_partkey") % len(_STATEMENTS) == i, filled(x[c])) for i, x in enumerate(_STATEMENTS)))
    p = star.read(spark, d, "part").select("p_partkey", by_part(0).alias("kind"), by_part(1).alias("sql"))
    found = p.select("p_partkey", tx.sql_tables("sql", "kind").alias("t"))
    return found.select("p_partkey", F.array_join("t.writes", ",").alias("writes"), F.array_join("t.reads", ",").alias("reads"))


_NAME = "CASE p_partkey % 4 WHEN 0 THEN concat(' [DB] . `', p_brand, '\"') WHEN 1 THEN concat('dbo.[', p_brand, '] ') WHEN 2 THEN concat('\"A\" .\"b\". c', CAST(p_partkey AS VARCHAR(20))) ELSE p_brand END"


@query(rf"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace({_NAME}, '[\[\]`"'']', '', 'g'), '\s*\.\s*', '.', 'g'))) AS name FROM part""")
def sql_identifier_norm(spark, d):
    return star.read(spark, d, "part").select("p_partkey", tx.table_name(F.expr(_NAME)).alias("name"))


# --- documents: citations, budgets, batches, fingerprints, text safety


@query("SELECT doc_id, unnest(regexp_extract_all(text || ' see src/a.java:' || CAST(doc_id AS VARCHAR), '([A-Za-z0-9_./-]+\\.[A-Za-z]+:[0-9]+)', 1)) AS citation FROM documents")
def citations_extract(spark, d):
    return star.read(spark, d, "documents").select("doc_id", F.explode(tx.citations(F.concat("text", F.lit(" see src/a.java:"), F.col("doc_id").cast("string")))).alias("citation"))


@query("SELECT d.doc_id, lines, d.doc_id % 40 AS cited, d.doc_id % 40 BETWEEN 1 AND lines AS valid FROM (SELECT doc_id, CAST(coalesce(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), 0) AS BIGINT) AS lines FROM documents) d")
def citations_validate(spark, d):
    n = tx.line_count(F.col("text")).cast("long")
    return star.read(spark, d, "documents").select("doc_id", n.alias("lines"), (F.col("doc_id") % 40).alias("cited"), (F.col("doc_id") % 40).between(1, n).alias("valid"))


@query("SELECT doc_id, source, CAST(bytes AS BIGINT) AS bytes FROM (SELECT doc_id, source, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS bytes FROM documents) WHERE bytes <= 20000")
def byte_budget_prefix(spark, d):
    return budget.byte_prefix(star.read(spark, d, "documents"), "source", "doc_id", "text", 20000).select("doc_id", "source", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT doc_id, source, CAST(rank AS INTEGER) AS rank, n > 20 AS truncated FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rank <= 20")
def caps_with_flags(spark, d):
    return budget.capped(star.read(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 20).select("doc_id", "source", "rank", "truncated")


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
  b AS (SELECT lang, doc_id, n_chars, k, 0 AS batch, n_chars AS held, 1 AS n FROM o WHERE k = 1
    UNION ALL SELECT o.lang, o.doc_id, o.n_chars, o.k, CASE WHEN b.held + o.n_chars > 60000 OR b.n >= 12 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.held + o.n_chars > 60000 OR b.n >= 12 THEN o.n_chars ELSE b.held + o.n_chars END, CASE WHEN b.held + o.n_chars > 60000 OR b.n >= 12 THEN 1 ELSE b.n + 1 END
    FROM b JOIN o ON o.lang = b.lang AND o.k = b.k + 1)
  SELECT lang, doc_id, CAST(batch AS INTEGER) AS batch FROM b""")
def batch_packing(spark, d):
    return budget.pack_batches(star.read(spark, d, "documents"), "lang", "n_chars", "doc_id", 60000, 12).select("lang", "doc_id", "batch")


@query("""WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
  SELECT CASE WHEN old.h IS NULL THEN 'new' WHEN old.h = c.h THEN 'reused' ELSE 'parsed' END AS status, count(*) AS n FROM c LEFT JOIN old ON old.doc_id = c.doc_id GROUP BY 1""")
def fingerprint_reuse(spark, d):
    docs = star.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("h")).alias("old_h"))
    return docs.join(old, "doc_id", "left").groupBy(F.when(F.col("old_h").isNull(), "new").when(F.col("old_h") == F.col("h"), "reused").otherwise("parsed").alias("status")).agg(_long("n"))


#: Characters of each kind that a plain text does not keep: format, separators of lines and paragraphs, control.
_UNSAFE = "\u200b\u200ba\u00ad\u2028\u2029b\x7f\ufeffc\x85"


@query(f"SELECT doc_id, trim(regexp_replace(concat(text, '{_UNSAFE}'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Zl}}\\p{{Zp}}]+', ' ', 'g')) AS plain FROM documents")
def text_safety(spark, d):
    return star.read(spark, d, "documents").select("doc_id", F.trim(tx.plain_text(F.concat("text", F.lit(_UNSAFE)))).alias("plain"))


@query("""SELECT doc_id, count(*) AS chunks, CAST(sum(length(c)) AS BIGINT) AS chars FROM (SELECT DISTINCT doc_id, substr(text, CAST(i * 900 + 1 AS INTEGER), 1000) AS c FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)))) AS i)) GROUP BY doc_id""")
def text_chunking(spark, d):
    pieces = tx.chunks(F.col("text"), 1000, 100)
    return star.read(spark, d, "documents").select("doc_id", F.size(pieces).cast("long").alias("chunks"), F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


_SCOPE = "CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN concat(p_type, ' / ', p_name, ' (', p_brand, ') and a long tail of words beyond it') WHEN 2 THEN concat(CASE WHEN p_partkey % 4 = 0 THEN 'Com' ELSE 'lpt' END, CAST(p_partkey % 14 AS VARCHAR(20))) WHEN 3 THEN lower(replace(p_name, ' ', '-')) WHEN 4 THEN concat('***', CASE WHEN p_partkey % 8 = 4 THEN '' ELSE ' x' END) ELSE '  ' END"


@query(f"""WITH t AS (SELECT p_partkey, lower(trim({_SCOPE})) AS t FROM part), r AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'scope') AS readable FROM t)
  SELECT p_partkey, CASE WHEN t = '' THEN 'scope' WHEN regexp_full_match(t, '[a-z0-9]+(-[a-z0-9]+)*') AND length(t) <= 48 AND NOT regexp_full_match(t, 'con|prn|aux|nul|com[1-9]|lpt[1-9]') THEN t
    ELSE coalesce(nullif(regexp_replace(left(readable, 30), '-+$', ''), ''), 'scope') || '--' || left(sha256(t), 16) END AS slug FROM r""")
def scope_slug(spark, d):
    return star.read(spark, d, "part").select("p_partkey", tx.slug(F.expr(_SCOPE)).alias("slug"))


# --- sets, sources, statuses


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, d):
    li = star.read(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").subtract(li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_orders, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_lines")
def set_equality(spark, d):
    o, li = star.read(spark, d, "orders").select("o_orderkey"), star.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.subtract(li).agg(_long("only_orders")).withColumn("k", F.lit(0)).join(li.subtract(o).agg(_long("only_lines")).withColumn("k", F.lit(0)), "k").drop("k")


@query("SELECT source AS file FROM documents UNION SELECT event_type FROM events UNION SELECT role FROM conversations")
def union_sources(spark, d):
    return star.read(spark, d, "documents").select(F.col("source").alias("file")).union(star.read(spark, d, "events").select("event_type")).union(star.read(spark, d, "conversations").select("role")).distinct()


@query("SELECT event_type AS status, count(*) AS n, count(*) FILTER (value > 50) AS reused FROM events GROUP BY event_type")
def status_counts(spark, d):
    return star.read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(_long("n"), F.count_if(F.col("value") > 50).alias("reused"))


@query("SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY event_type, user_id, event_id) AS INTEGER) AS position FROM events")
def diagnostics_order(spark, d):
    placed = budget.positions(star.read(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id", "event_id"])
    return placed.select("event_id", "event_type", F.col("position").cast("int").alias("position"))


@query("SELECT median(l_extendedprice) AS median_price, max(l_quantity) / min(l_quantity) AS ratio FROM lineitem")
def median_ratio(spark, d):
    return star.read(spark, d, "lineitem").agg(F.median("l_extendedprice").alias("median_price"), (F.max("l_quantity") / F.min("l_quantity")).alias("ratio"))
