import os

from pyspark.sql import functions as F

from weftline import cli
from weftline.functions import text as tx
from weftline.plans import index
from weftline.sources import cache, parsers, project
from weftline.streaming import facts as stream

from . import shop


def test_commands(spark, tmp_path):
    root = tmp_path / "shop"
    root.mkdir()
    shop.write(root)
    (root / "empty.properties").write_text("# nothing\n")
    run = lambda *argv: cli.run(spark, list(argv))
    code, lines = run("analyze", str(root), "--json")
    assert code == cli.OK and '"reused": 0' in lines[0] and '"total"' in lines[0]
    code, lines = run("analyze", str(root))
    parsed = next(int(x.split()[1]) for x in lines if x.startswith("parsed:"))
    assert f"reused: {parsed}" in lines  # also the file without facts
    (root / "empty.properties").write_text("a=1\n")
    assert f"reused: {parsed - 1}" in run("analyze", str(root))[1]
    assert any(x.startswith("nodes table: ") for x in run("overview", str(root))[1])
    code, lines = run("search", str(root), "CartDao")
    assert code == cli.OK and any(x.startswith("java_type:com.shop.dao.CartDao (score 850); src/com/shop/dao/CartDao.java:2") for x in lines)
    assert run("search", str(root), "no such thing")[0] == cli.NO_MATCH
    code, lines = run("trace-table", str(root), "dbo.cart")
    assert code == cli.OK and any("page:/cart/list.jsp" in x for x in lines)
    assert run("trace-url", str(root), "nowhere at all")[0] == cli.NO_MATCH
    assert run("search", str(root), "x" * 2000) == (cli.ERROR, ["error: more than 1024 characters"])
    assert run("overview", str(root / "missing"))[0] == cli.ERROR and run("unknown", "x")[0] == cli.ERROR
    (root / "q.txt").write_text("stock\n")
    code, lines = run("docs", str(root), "--query-file", "q.txt", "--output", str(tmp_path / "out"))
    assert code == cli.OK and all(os.path.exists(x) for x in lines) and "/stock/" in lines[0]
    assert run("docs", str(root), "--query-file", "../outside")[0] == cli.ERROR
    (root / "doc.md").write_text("## 1. Overview\nsee web/cart/list.jsp:2\n")
    code, lines = run("validate-doc", str(root), "doc.md")
    assert code == cli.INVALID and any(x.startswith("heading") for x in lines)

    graph = index.load(spark, str(root / ".weft/index"))
    assert index.validate(graph) == []
    wrong = index.Graph(graph.nodes, graph.edges, spark.createDataFrame([("parser-error", "at /home/me/x.java")], "code string, subject string"))
    assert index.validate(wrong, index.summary(graph).withColumn("n", F.col("n") + 1))[0].startswith("count of")
    assert "machine path in a warning" in index.validate(wrong)


def test_cache_that_cannot_be_used(spark, tmp_path):
    assert cache.load(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "other"))
    assert cache.load(spark, str(tmp_path / "other")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.parquet").write_text("not parquet")
    assert cache.load(spark, str(tmp_path / "bad")) is None
    (tmp_path / "file").write_text("x")
    assert cache.save(spark.createDataFrame([], parsers.SCHEMA), str(tmp_path / "file/x")) != ""


def test_stream_parses_only_what_changed(spark, tmp_path):
    root, scans, facts, state = (str(tmp_path / x) for x in ("tree", "scans", "facts", "state"))
    os.makedirs(root)
    write = lambda name, text: open(f"{root}/{name}", "w").write(text)
    write("a.properties", "k=1\n")
    write("b.properties", "k=2\n")
    def scan():
        stream.publish(project.scan(spark, root), scans)
        stream.follow(spark, scans, facts, state).awaitTermination()
        return {(r.path, r.data.get("value")) for r in stream.latest(spark, scans, facts).where("kind = 'property'").collect()}

    assert scan() == {("a.properties", "1"), ("b.properties", "2")}
    write("b.properties", "k=3\n")
    os.utime(f"{root}/b.properties", (2_000_000_000, 2_000_000_000))
    assert scan() == {("a.properties", "1"), ("b.properties", "3")}
    assert sorted((r.path, r.batch) for r in spark.read.parquet(facts).where("kind = 'file'").collect()) == [("a.properties", 0), ("b.properties", 0), ("b.properties", 1)]


def test_strict_paths(spark):
    good, bad = ["a/b.java", "x"], ["/a", "a/../b", "C:/x", "a/con.txt", "a/b.", "a/b ", "a?b", "x" * 256, "a//b", "lpt1"]
    rows = spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", tx.path_is_strict(F.col("p")).alias("ok")).collect()
    assert {r.p for r in rows if r.ok} == set(good)
