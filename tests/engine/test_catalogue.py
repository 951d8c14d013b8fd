"""Catalogue queries over whole tables, held against brute force."""

import re

import duckdb
from pyspark.sql import functions as F

from weftline.operators import budget, match
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_alternate_branches_of_all_orders(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    assert max(r.l_orderkey for r in lines) > 500
    want = []
    for key in {r.l_orderkey for r in lines}:
        own, seen = [r for r in lines if r.l_orderkey == key], set()
        for rank in sorted({r.l_linenumber for r in own}):
            level = [r for r in own if r.l_linenumber == rank]
            shown = {x for r in level for x in (r.l_partkey, r.l_suppkey)}
            if shown - seen:
                want += [(key, rank)] * len(level)
            seen |= shown
    assert sorted((r.l_orderkey, r.rank) for r in catalogue.alternate_branches(spark, SF).collect()) == sorted(want)


def test_diagnostics_order_places_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "user_id", "event_id").collect()
    want = [(r.event_id, r.event_type, i + 1) for i, r in enumerate(sorted(events))]
    assert len(want) > 200
    got = [tuple(r) for r in catalogue.diagnostics_order(spark, SF).collect()]
    assert sorted(got, key=lambda r: r[2]) == want


def test_positions_over_many_parts(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "id % 3 AS g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = budget.positions(rows, ["g", "k"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.g, r.k) for r in sorted(placed, key=lambda r: r.position)] == sorted((r.g, r.k) for r in placed)
    assert sorted(r.position for r in placed) == list(range(1, 5001))


def test_citations_validate_keeps_every_document(spark, tmp_path):
    texts = {1: "a\r\nb\r\nc", 2: "a\rb", 3: "", 4: None, 5: "a\n\r\n\rb\n", 6: "one", 41: "", 42: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.lines, r.cited, r.valid) for r in catalogue.citations_validate(spark, str(tmp_path)).collect()}
    lines = {1: 3, 2: 2, 3: 1, 4: 0, 5: 5, 6: 1, 41: 1, 42: 0}
    assert got == {i: (n, i % 40, 1 <= i % 40 <= n) for i, n in lines.items()}


def test_prefix_route_match_takes_patterns_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    url = {r.page_id: re.sub(r"^[a-z]+://[^/]+|[?#].*$", "", r.url) for r in pages}
    firsts = {re.match("(/[^/]*)?", u)[0] + "/*" for u in url.values()}
    want = {(i, u, u) for i, u in url.items()} | {(i, u, p) for i, u in url.items() for p in firsts if u.startswith(p[:-1])}
    assert {tuple(r) for r in catalogue.prefix_route_match(spark, SF).select("page_id", "url", "pattern").collect()} == want


def test_tiered_name_resolution_of_a_name_that_many_parts_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 16)
    parts = [(i, "bolt" if i % 9 else f"only{i}", "b") for i in range(150)] + [(5, "only9", "c"), (None, "bolt", "n"), (200, None, "d"), (201, "twice", "e"), (201, "twice", "e"), (202, "last", None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0,), (3,), (10,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = []
    for ref in {r[0] for r in parts}:
        own = [r for r in parts if r[0] == ref]
        tiers = [[f"supplier:{ref}" for _ in own if ref in (0, 3, 10)], [f"part:{q[0]}" for r in own for q in parts if q[1] == r[1] is not None and None not in (ref, q[0]) and q[0] != ref], [r[2] and f"brand:{r[2]}" for r in own]]
        tier = next(i for i, t in enumerate(tiers) if t)
        want += [(ref, t, tier) for t in tiers[tier]]
    got = catalogue.tiered_name_resolution(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # pairs meet in blocks: no value's rows are all dealt to one place
    names = spark.createDataFrame([(i, "x") for i in range(400)], "ref long, name string")
    met = match.sharing(names, names.selectExpr("name", "ref AS self", "ref AS target"), "name", "ref")
    assert sorted(map(tuple, met.collect())) == [(a, b) for a in range(400) for b in range(400) if a != b]


def test_sharing_deals_the_pairs_of_few_rows_and_of_repeats_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 16)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        names = spark.createDataFrame([(i, "x") for i in range(200)], "ref long, name string")
        repeats = spark.createDataFrame([("x", 7, f"part:{i % 3}") for i in range(400)], "name string, self long, target string")
        for known, n in ((names.selectExpr("name", "ref AS self", "concat('part:', ref) AS target"), 200 * 199), (repeats, 199 * 400)):
            # one block of asks: only the blocks of known can spread its pairs
            met = match.sharing(names, known, "name", "ref").withColumn("at", F.spark_partition_id()).collect()
            assert len(met) == n and len({r.at for r in met}) > 6
            one = match.sharing(names.where("ref = 3"), known, "name", "ref").withColumn("at", F.spark_partition_id()).collect()
            assert len(one) == (400 if known is repeats else 199) and len({r.at for r in one}) > 4
        assert sorted(r.target for r in one) == sorted(f"part:{i % 3}" for i in range(400))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_node_merge_takes_rows_of_one_order_as_they_come(spark, tmp_path):
    """Equal orders, missing flags and orders, several files: as the SQL gives them where DuckDB reads rows in turn."""
    rows = [(1, 1, 1, "R", "O"), (1, 1, 1, "A", "F"), (1, 1, 2, "N", "O"), (2, 3, 1, "A", "F"), (1, 1, 1, "N", "P"), (2, 2, 1, None, "P"), (3, None, 1, "R", "O"), (3, 5, 1, "N", None), (3, None, 1, "A", "O"), (4, None, 1, "R", "F"), (2, 2, 1, "R", "O"), (2, 2, 1, "N", "F")]
    for i, part in enumerate((rows[:7], rows[7:])):
        spark.createDataFrame(part, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").selectExpr("*", "30D AS l_quantity").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{i} part.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.SQL["node_merge"]).fetchall()
    assert ("part:1", "R", "O", "R,A,N") in want
    assert sorted(map(tuple, catalogue.node_merge(spark, str(tmp_path)).collect())) == sorted(want)
