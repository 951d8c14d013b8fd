import json

import pytest

from weftline.operators import traverse
from weftline.plans import docmodel, render, resolve
from weftline.sources import parsers, project

from . import shop


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    shop.write(root)
    facts = parsers.facts(project.scan(spark, str(root))).cache()
    return facts, resolve.build(facts)


def test_model_and_documents(graph):
    facts, g = graph
    model = docmodel.build(g, facts)
    cases = {c["route"]: c for c in model.use_cases.collect()}
    cart = cases["/cart.do"]
    assert cart["module"] == "root" and {(t["table"], t["access"]) for t in cart["tables"]} >= {("dbo.cart", "write"), ("stock", "read"), ("cart", "read")}
    assert "page:/cart/list.jsp" in {t["source"] for t in cart["triggers"]} and "cart.save" in cart["statements"]
    assert cart["main_flow"][0] == "route:/cart.do" and 0 < cart["confidence"] <= 1
    assert cases["/cart/help.do"]["module"] == "cart"
    pages = {p["id"]: p for p in model.pages.collect()}
    assert {f["name"] for f in pages["page:/cart/list.jsp"]["fields"]} == {"cartId", "size", "loose"}
    text = render.use_case_markdown(model) + render.page_markdown(model) + render.navigation_diagram(g)
    assert "/cart.do" in text and "flowchart LR" in text and "table dbo.cart: write" in text
    assert {r["module"] for r in model.modules.collect()} >= {"cart", "root"} and docmodel.matrix(model).count() >= 3


def test_flows_equal_single_traversals(graph):
    _, g = graph
    tables = g.nodes.where("type = 'table'").select("id")
    starts = docmodel.executable(g).select("id")
    got = {}
    for r in docmodel.flows(g.edges, starts, tables).collect():
        got.setdefault(r.start, []).append(r.nodes)
    for start in (r.id for r in starts.collect()):
        t = traverse.traverse(g.edges, [start], "outgoing", docmodel.FLOW, ends=tables)
        assert sorted(got.get(start, [])) == sorted(p["nodes"] for p in t.paths), start


def test_scope_and_evidence(graph):
    _, g = graph
    assert {r.id for r in docmodel.scope(g, "cart").collect()} == {"route:/cart/help.do"}
    assert "route:/cart.do" in {r.id for r in docmodel.scope(g, "stock").collect()}
    found = docmodel.technical_evidence(g, "cart.save")
    assert "db/procs.sql" not in {r.file for r in found["files"].collect()} and found["edges"].count() > 3
    trace = found["trace"]
    shown = render.trace_markdown(trace, g, "cart.save")
    assert "## Proven" in shown and "cart.save" in shown


def test_budget_and_export(graph, tmp_path):
    _, g = graph
    out = render.within_budget(["```", *("x" * 50 for _ in range(100))], 500)
    assert len(out.encode()) <= 500 and out.count("```") == 2 and out.rstrip().endswith("reached")
    text = render.graph_json(g)
    render.write_atomic(str(tmp_path / "a/graph.json"), text)
    read = json.loads((tmp_path / "a/graph.json").read_text())
    assert read["summary"]["nodes"]["table"] >= 4 and read["nodes"] == sorted(read["nodes"], key=lambda n: n["id"])


def test_document_check():
    good = "".join(f"{h}\nsee src/A.java:2\n" for h in docmodel.HEADINGS)
    assert docmodel.check_document(good, {"src/A.java": 3}) == []
    assert docmodel.check_document(good, {"src/A.java": 1})[0].startswith("line 2")
    flow = "## 5. Data Flow"
    assert any(x.startswith(f"heading {flow}") for x in docmodel.check_document(good.replace(flow, "## Other"), {"src/A.java": 3}))
    assert any(x.startswith(f"heading {flow}: 2") for x in docmodel.check_document(good + flow + "\nNeeds verification\n", {"src/A.java": 3}))
    fenced = good.replace(f"{flow}\nsee src/A.java:2", f"{flow}\n```\nsee src/A.java:2\n```")
    assert docmodel.check_document(fenced, {"src/A.java": 3}) == [f"section {flow}: no citation"]
    assert docmodel.check_document(fenced.replace("```\nsee", "Needs verification\n```\nsee"), {"src/A.java": 3}) == []
    bare = "".join(f"{h}\nNeeds verification\n" for h in docmodel.HEADINGS)
    assert docmodel.check_document(bare, {}) == ["no citation"]
    assert docmodel.check_document(good + "`../x.java:1` and `my file.sql:9`", {"src/A.java": 3, "my file.sql": 2}) == ["unsafe path ../x.java", "line 9 beyond my file.sql"]
    assert docmodel.check_document(good, {"src/A.java": 3}, {"src/B.java"})[0].startswith("file outside")
    assert docmodel.cited("see `a b.sql:3`, src/x.java:4.") == [("a b.sql", 3), ("src/x.java", 4)]
