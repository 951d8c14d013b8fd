"""The property graph of the driver's star tables, in Spark and as SQL text for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scratch import ready


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with each row's place in it, file (where there are several) and row."""
    df = read(spark, sf_dir, name)
    file = F.col("_metadata.file_path") if len(df.inputFiles()) > 1 else F.lit("")
    return df.withColumns({"file": file, "row": F.col("_metadata.row_index")})


# node type, table, key, name column
NODES = (
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("order", "orders", "o_orderkey", "o_orderstatus"),
)
# edge type, table, source type, source key, target type, target key
EDGES = (
    ("in_nation", "customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ("in_nation", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("in_region", "nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("placed_by", "orders", "order", "o_orderkey", "customer", "o_custkey"),
    ("contains", "lineitem", "order", "l_orderkey", "part", "l_partkey"),
    ("supplied_by", "lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
)


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name")) for kind, t, key, name in NODES]
    return reduce(DataFrame.unionByName, parts)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as found, one for each row; confidence 1."""
    parts = [read(spark, sf_dir, t).select(_id(a, ak).alias("source"), _id(b, bk).alias("target"), F.lit(kind).alias("type")) for kind, t, a, ak, b, bk in EDGES]
    return reduce(DataFrame.unionByName, parts)


def _distinct(spark: SparkSession, sf_dir: str, use: tuple) -> DataFrame:
    """The edges of a list like EDGES with ids; repeats go by key, before ids are made."""
    parts = []
    for kind, t, a, ak, b, bk in use:
        keys = read(spark, sf_dir, t).select(F.col(ak).alias("_a"), F.col(bk).alias("_b"))
        keys = keys.distinct() if t == "lineitem" else keys
        parts.append(keys.select(_id(a, "_a").alias("source"), _id(b, "_b").alias("target"), F.lit(kind).alias("type")))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.concat_ws("|", "source", "type", "target", F.lit("key")).alias("id"), "source", "target", "type", F.lit(1.0).alias("confidence"))


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct edges with ids."""
    return _distinct(spark, sf_dir, tuple(e for e in EDGES if kinds is None or e[0] in kinds))


# The same tables as a small application, for traces by mode: pages, routes, methods, statements, procedures, tables.
APP_NODES = (
    ("page", "customer", "c_custkey", "c_name"),
    ("route", "orders", "o_orderkey", "o_orderpriority"),
    ("java_method", "part", "p_partkey", "p_name"),
    ("statement", "supplier", "s_suppkey", "s_name"),
    ("procedure", "nation", "n_nationkey", "n_name"),
    ("table", "region", "r_regionkey", "r_name"),
)
APP_EDGES = (
    ("submits_to", "orders", "page", "o_custkey", "route", "o_orderkey"),
    ("dispatches_to", "lineitem", "route", "l_orderkey", "java_method", "l_partkey"),
    ("uses_statement", "lineitem", "java_method", "l_partkey", "statement", "l_suppkey"),
    ("calls_procedure", "supplier", "statement", "s_suppkey", "procedure", "s_nationkey"),
    ("writes_to", "nation", "procedure", "n_nationkey", "table", "n_regionkey"),
)


def app(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the application."""
    parts = [read(spark, sf_dir, t).select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name")) for kind, t, key, name in APP_NODES]
    return reduce(DataFrame.unionByName, parts), _distinct(spark, sf_dir, APP_EDGES)


def nodes_sql(rows: tuple) -> str:
    return " UNION ALL ".join(f"SELECT '{k}:' || CAST({key} AS VARCHAR) AS id, '{k}' AS type, {name} AS name FROM {t}" for k, t, key, name in rows)


NODES_SQL = nodes_sql(NODES)


def edges_sql(kinds: tuple[str, ...] | None = None, rows: tuple = EDGES) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {'DISTINCT ' if t == 'lineitem' else ''}'{a}:' || CAST({ak} AS VARCHAR) AS source, '{b}:' || CAST({bk} AS VARCHAR) AS target, '{kind}' AS type FROM {t}" for kind, t, a, ak, b, bk in rows if kinds is None or kind in kinds
    )
    return f"SELECT source || '|' || type || '|' || target || '|key' AS id, source, target, type, CAST(1.0 AS DOUBLE) AS confidence FROM ({parts})"


WITH = f"WITH nodes AS ({NODES_SQL}), edges AS ({edges_sql()})"
#: A text as it sorts in the root locale, in DuckDB.
SORT = "icu_sort_key({}, 'en')"


def trace_sql(edges: str, starts: str, direction: str, depth: int, max_paths: int, max_states: int, tag: str = "t") -> str:
    """The bounded traversal as common table expressions: all states, their order, then the limits by running counts.

    edges and starts (id, idx) are queries. found_<tag> gets the paths, end_<tag> one row of counters and
    flags. It holds whenever all states fit in memory; the engine itself stops early.
    """
    at, to = ("source", "target") if direction == "outgoing" else ("target", "source")
    held = "{} LIKE 'table:%'" if direction == "outgoing" else "false"
    return f"""steps_{tag} AS (SELECT {at} AS at, {to} AS dest, id, {SORT.format('id')} AS k FROM ({edges})),
    states_{tag} AS (
      SELECT CAST(id AS VARCHAR) AS at, [CAST(id AS VARCHAR)] AS nodes, CAST([] AS VARCHAR[]) AS keys, 0 AS depth, CAST(idx AS BIGINT) AS idx, {held.format('id')} AS held FROM ({starts})
      UNION ALL
      SELECT e.dest, list_append(s.nodes, e.dest), list_append(s.keys, e.k), s.depth + 1, s.idx, {held.format('e.dest')}
      FROM states_{tag} s JOIN steps_{tag} e ON e.at = s.at WHERE s.depth < {depth} AND NOT s.held AND NOT list_contains(s.nodes, e.dest)
    ),
    more_{tag} AS (
      SELECT s.idx, s.keys, count(*) AS n FROM states_{tag} s JOIN steps_{tag} e ON e.at = s.at WHERE NOT s.held AND NOT list_contains(s.nodes, e.dest) GROUP BY s.idx, s.keys
    ),
    ranked_{tag} AS (
      SELECT s.nodes, s.depth, coalesce(m.n, 0) AS n, row_number() OVER (ORDER BY s.depth, s.idx, s.keys) AS rk, CASE WHEN s.depth >= {depth} THEN 0 ELSE coalesce(m.n, 0) END AS kids
      FROM states_{tag} s LEFT JOIN more_{tag} m ON m.idx = s.idx AND m.keys = s.keys
    ),
    counted_{tag} AS (
      SELECT *, (SELECT count(*) FROM ({starts})) + sum(kids) OVER (ORDER BY rk) AS cum, kids = 0 AND depth > 0 AS emits,
        sum(CASE WHEN kids = 0 AND depth > 0 THEN 1 ELSE 0 END) OVER (ORDER BY rk) AS emitted
      FROM ranked_{tag}
    ),
    limits_{tag} AS (SELECT min(CASE WHEN cum > {max_states} THEN rk END) AS h, min(CASE WHEN emitted >= {max_paths} THEN rk END) AS p, max(rk) AS last FROM counted_{tag}),
    stop_{tag} AS (SELECT (p IS NOT NULL AND (h IS NULL OR p < h)) AS by_path, (h IS NOT NULL AND (p IS NULL OR h <= p)) AS by_state, CASE WHEN p IS NOT NULL AND (h IS NULL OR p < h) THEN p WHEN h IS NOT NULL THEN h ELSE last END AS rk FROM limits_{tag}),
    whole_{tag} AS (SELECT c.nodes, c.depth, c.n > 0 AS truncated FROM counted_{tag} c, stop_{tag} x WHERE c.emits AND (c.rk < x.rk OR (c.rk = x.rk AND NOT x.by_state))),
    waiting_{tag} AS (
      SELECT c.nodes, c.depth, row_number() OVER (ORDER BY c.depth DESC, {SORT.format("array_to_string(c.nodes, ',')")}, c.rk) AS place FROM counted_{tag} c, stop_{tag} x
      WHERE x.by_state AND c.rk >= x.rk AND c.rk <= {max_states} AND c.depth > 0
    ),
    found_{tag} AS (
      SELECT nodes, depth, truncated FROM whole_{tag}
      UNION ALL SELECT nodes, depth, true FROM waiting_{tag} WHERE place <= {max_paths} - (SELECT count(*) FROM whole_{tag})
    ),
    end_{tag} AS (
      SELECT x.rk AS expanded, CASE WHEN x.by_state THEN {max_states} ELSE (SELECT cum FROM counted_{tag} c WHERE c.rk = x.rk) END AS enqueued, x.by_state AS state_limit,
        CASE WHEN x.by_path THEN (SELECT cum FROM counted_{tag} c WHERE c.rk = x.rk) > x.rk WHEN x.by_state THEN (SELECT count(*) FROM waiting_{tag}) > {max_paths} - (SELECT count(*) FROM whole_{tag}) ELSE false END AS path_limit,
        EXISTS (SELECT 1 FROM counted_{tag} c WHERE c.n > 0 AND c.kids = 0 AND c.rk <= x.rk) AS depth_limit
      FROM stop_{tag} x
    )"""


def paths_sql(*tags: str) -> str:
    """The paths of one traversal, or of several together, each once."""
    parts = " UNION ".join(f"SELECT array_to_string(nodes, ' > ') AS path, CAST(depth AS INTEGER) AS steps, truncated FROM found_{t}" for t in tags)
    return f"SELECT path, steps, truncated FROM ({parts})"


def counters_sql(*tags: str) -> str:
    """Counters by sum, flags by or."""
    parts = " UNION ALL ".join(f"SELECT * FROM end_{t}" for t in tags)
    return f"SELECT CAST(sum(expanded) AS BIGINT) AS expanded, CAST(sum(enqueued) AS BIGINT) AS enqueued, bool_or(state_limit) AS state_limit, bool_or(path_limit) AS path_limit, bool_or(depth_limit) AS depth_limit FROM ({parts})"


def trace_report_sql(*tags: str) -> str:
    """Paths, counters and limit warnings as rows of one table."""
    return f"""SELECT 'path' AS what, path AS value, steps, truncated FROM ({paths_sql(*tags)})
    UNION ALL SELECT unnest(['expanded', 'enqueued']), '', CAST(unnest([expanded, enqueued]) AS INTEGER), false FROM ({counters_sql(*tags)})
    UNION ALL SELECT 'warning', w, 0, false FROM (SELECT unnest([CASE WHEN state_limit THEN 'state_limit' END, CASE WHEN path_limit THEN 'path_limit' END, CASE WHEN depth_limit THEN 'depth_limit' END]) AS w FROM ({counters_sql(*tags)})) WHERE w IS NOT NULL"""
