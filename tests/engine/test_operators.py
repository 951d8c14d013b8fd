import random

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import budget, match, merge, search, traverse
from weftline.sources import project


def naive(edges, starts, depth, max_paths, max_states):
    """The traversal, path by path."""
    near = {}
    for i, s, t in sorted(edges):
        near.setdefault(s, []).append((i, t))
    queue, at, paths, nodes = [([s], []) for s in starts], 0, [], set(starts)
    n, expanded, flags = len(queue), 0, {"state": False, "path": False, "depth": False}
    halted = None
    while at < len(queue) and len(paths) < max_paths and halted is None:
        if expanded >= max_states:
            flags["state"] = True
            break
        path, ids = queue[at]
        at, expanded = at + 1, expanded + 1
        nxt = [(i, t) for i, t in near.get(path[-1], []) if t not in path]
        if not nxt or len(ids) >= depth:
            flags["depth"] |= bool(nxt)
            if len(path) > 1:
                paths.append(path)
            continue
        for i, t in nxt:
            if n >= max_states:
                flags["state"], halted = True, path
                break
            nodes.add(t)
            queue.append(([*path, t], [*ids, i]))
            n += 1
    if len(paths) >= max_paths and at < len(queue):
        flags["path"] = True
    return paths, nodes, expanded, flags


def test_traverse_matches_naive_search(spark):
    rng = random.Random(6)
    for k in range(6):
        ids = [f"n{i}" for i in range(7)]
        pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(14)})
        edges = [(f"{s}|x|{t}|r", s, t) for s, t in pairs]
        df = spark.createDataFrame([(i, s, t, "x") for i, s, t in edges], "id string, source string, target string, type string")
        for depth, paths, states in ((14, 100, 5000), (2, 100, 5000), (14, 3, 5000), (14, 100, 9))[k % 4 : k % 4 + 1]:
            want = naive(edges, ["n0", "n1"], depth, paths, states)
            got = traverse.traverse(df, ["n0", "n1"], "outgoing", None, depth, paths, states)
            assert got.nodes == want[1] and got.expanded == want[2]
            assert (got.state_limit, got.depth_limit) == (want[3]["state"], want[3]["depth"])
            if not got.state_limit:
                assert sorted(p["nodes"] for p in got.paths) == sorted(want[0]) and got.path_limit == want[3]["path"]


def test_traces_by_mode(spark):
    nodes = spark.createDataFrame([("route:/a", "route", "/a"), ("java_method:m", "java_method", "m"), ("statement:s.a", "statement", "s.a"), ("statement:s.b", "statement", "s.b"), ("table:t", "table", "t"), ("page:/p", "page", "/p")], "id string, type string, name string")
    rows = [("page:/p", "submits_to", "route:/a"), ("route:/a", "dispatches_to", "java_method:m"), ("java_method:m", "uses_statement", "statement:s.a"), ("java_method:m", "uses_statement", "statement:s.b"), ("statement:s.a", "reads_from", "table:t"), ("statement:s.b", "writes_to", "table:t"), ("table:t", "reads_from", "page:/p"), ("page:/p", "contains", "table:t")]
    edges = spark.createDataFrame([(f"{a}|{k}|{b}|r", a, b, k) for a, k, b in rows], "id string, source string, target string, type string")
    t = traverse.trace_statement(nodes, edges, "s.a")
    assert t.matches == ["statement:s.a"] and t.warnings == [] and [p["nodes"][-1] for p in t.paths] == ["statement:s.b", "table:t"]  # backwards a table doesn't end a path
    assert len(t.paths[0]["nodes"]) == 6 and t.max_states == 5000
    assert [p["nodes"] for p in traverse.trace_url(nodes, edges, "/a").paths] == [["route:/a", "java_method:m", f"statement:s.{x}", "table:t"] for x in "ab"]
    assert traverse.trace_table(nodes, edges, "t").paths[0]["nodes"][0] == "table:t"
    assert traverse.trace_feature(nodes, edges, "/p").matches == ["page:/p"]
    none = traverse.trace_procedure(nodes, edges, "s.a")
    assert none.warnings == ["no_match"] and none.paths == [] and none.expanded == 0


def test_neighbours_in_the_order_of_the_locale(spark):
    ids = ["n:10", "n:1", "n:B", "n:a", "n:_", "n:Z"]
    edges = spark.createDataFrame([(f"s|x|{i}|k", "s", i, "x") for i in ids], "id string, source string, target string, type string")
    t = traverse.traverse(edges, ["s"], max_states=4)
    assert t.state_limit and t.enqueued == 4 and sorted(t.nodes) == ["n:1", "n:10", "n:_", "s"]
    whole = traverse.traverse(edges, ["s"])
    assert [p["nodes"][1] for p in whole.paths] == ["n:_", "n:1", "n:10", "n:a", "n:B", "n:Z"]
    assert [p["nodes"][1] for p in traverse.merge(spark, whole, whole).paths] == [p["nodes"][1] for p in whole.paths]


def test_merge_nodes(spark):
    rows = [(1, "a", "x", "t", None, ["e1", "e1"], ["s"], {"k": "1"}), (2, "a", "y", "t", "f", ["e1", "e2"], ["s", "r"], {"k": "2", "m": "3"}), (3, "b", "z", "t", None, ["e", "e"], [], None)]
    df = spark.createDataFrame(rows, "ord int, id string, name string, type string, file_path string, evidence array<string>, search_text array<string>, data map<string,string>")
    got = {r.id: r for r in merge.merge_nodes(df.repartition(3)).collect()}
    assert (got["a"].name, got["a"].file_path, got["a"].evidence, got["a"].search_text, got["a"].data) == ("x", "f", ["e1", "e2"], ["s", "r"], {"k": "2", "m": "3"})
    assert got["b"].evidence == ["e", "e"] and got["b"].data == {}


def test_search_scores(spark):
    df = spark.createDataFrame([("table:cart", "table", "Cart", "db/cart.sql", ["big cart of things"]), ("page:x", "page", "Ｃａｒｔ page", None, None), ("page:y", "page", "other", "web/cart.jsp", ["things big"])], "id string, type string, name string, file_path string, search_text array<string>")
    assert [(r.id, r.score) for r in search.search(df, " CART ").collect()] == [("table:cart", 1000), ("page:x", 850), ("page:y", 650)]
    assert [(r.id, r.score) for r in search.search(df, "things big").collect()] == [("page:y", 750), ("table:cart", 500)]
    assert search.search(df, "").count() == 0


def test_joins(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "q", 9)], "i int, k string, t int")
    right = spark.createDataFrame([("k", 2, "two"), ("k", 5, "five"), ("k", 6, "six")], "k string, u int, v string")
    assert {r.i: r.v for r in match.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {1: "five", 2: None, 3: None}
    climb = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "id string, parent string")
    hits = spark.createDataFrame([("a", "top"), ("b", "mid")], "owner string, found string")
    assert {(r.id, r.found, r.level) for r in traverse.nearest(climb, hits).collect()} == {("c", "mid", 1), ("b", "mid", 0), ("a", "top", 0)}
    url = spark.createDataFrame([(1, "/a/b/c"), (2, "/a"), (3, "/x"), (4, "/a/"), (5, "/a/*"), (6, "q")], "i int, url string")
    pat = spark.createDataFrame([("/a/*",), ("/a/b/c",), ("/*",), ("q",)], "pattern string")
    assert {(r.i, r.pattern) for r in match.prefix_routes(url, pat).collect()} == {(1, "/a/*"), (1, "/a/b/c"), (1, "/*"), (2, "/*"), (3, "/*"), (4, "/a/*"), (4, "/*"), (5, "/a/*"), (5, "/*"), (6, "q")}


def test_budgets(spark):
    df = spark.createDataFrame([("g", i, "x" * i) for i in range(1, 8)], "g string, i int, t string")
    assert [r.i for r in budget.byte_prefix(df, "g", "i", "t", 14).orderBy("i").collect()] == [1, 2, 3, 4]
    got = budget.capped(df, "g", ["i"], 3).collect()
    assert [r.i for r in got] == [1, 2, 3] and all(r.truncated for r in got)
    assert {r.i: r.batch for r in budget.pack_batches(df, "g", "i", "t", 9, 2).select(F.col("i"), "batch").collect()} == {7: 0, 6: 1, 5: 2, 4: 2, 3: 3, 2: 3, 1: 4}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.web_path(F.lit("app/src/main/webapp/a/b.jsp"))) == "/a/b.jsp" and one(tx.web_path(F.lit("q/c.jsp"))) == "/q/c.jsp"
    assert one(tx.query_params(F.lit("/a?x=1&x=2&y=3&z=${v}&=q"))) == {"x": "", "y": "3", "z": ""}
    assert one(tx.merge_params(tx.query_params(F.lit("/a?x=1&y=2")), tx.query_params(F.lit("/a?x=1&y=3&z=4")))) == {"x": "1", "y": "", "z": "4"}
    assert one(tx.sql_tables(F.lit("WITH r AS (SELECT 1) INSERT INTO [dbo] . [T] SELECT * FROM r JOIN b.c x -- FROM no"), F.lit("insert"))) == (["b.c"], ["dbo.t"])
    assert one(tx.signature_simple(F.lit("java.util.List,int"))) == "List,int" and one(tx.simple_name(F.lit("a.b.C<D>[]"))) == "C"
    assert one(tx.slug(F.lit("orders"))) == "orders" and one(tx.module_of(F.lit("/m/x.do?y"))) == "m"
    assert [len(p) for p in one(tx.chunks(F.lit("a" * 5 + "b" * 20), 10, 2))] == [10, 10, 9]
    links = {"../c.do?x#y": "/c.do", "http://x/y": None, "${pageContext.request.contextPath}/z/": "/z/", "${ctx}/q": "/q", "": "/a/b.jsp", "?x=1": "/a/b.jsp", "#t": None, "//h/p": None, "x/${y}": None, "..": "/", ".": "/a/", "../../../up": "/up", "//": None, "a//b/./c/": "/a/a/b/c/", None: None}
    df = spark.createDataFrame(list(enumerate(links)), "i int, t string").select("t", tx.url_resolved(F.lit("/a/b.jsp"), F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == links
    slugs = {"orders": "orders", " Orders ": "orders", "": "scope", "con": "con--", "com0": "com0", "lpt9": "lpt9--", "a_b": "a-b--", "é": "scope--", "Ａ1": "a1", "x" * 48: "x" * 48, "x" * 49: "x" * 30 + "--", "y" * 29 + "-" + "z" * 30: "y" * 29 + "--"}
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in slugs], "t string").select("t", tx.slug(F.col("t")).alias("u")).collect()}
    assert all(got[t] == s or s.endswith("--") and got[t].startswith(s) and len(got[t]) == len(s) + 16 for t, s in slugs.items()), got


def test_globs(spark):
    df = spark.createDataFrame([("a/b.java",), ("target/x.js",), ("gen/deep/y.sql",), ("z.PNG",)], "p string")
    assert [r.x for r in df.select(project.ignored(F.col("p"), ["gen/**"]).alias("x")).collect()] == [False, True, True, False]
    assert [r.x for r in df.select(project.language_of(F.col("p")).alias("x")).collect()] == ["java", "javascript", "sql", None]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i % 7, i, f"v{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ord int, v string")
    runs = []
    for n in (1, 5):
        d = df.repartition(n)
        runs.append((sorted(map(tuple, merge.first_wins(d, ["k"], ["ord"]).collect())), sorted(map(tuple, d.groupBy("k").agg(merge.ordered_union(F.array("v"), "ord").alias("u")).select("k", F.array_join("u", ",")).collect()))))
    assert runs[0] == runs[1]
