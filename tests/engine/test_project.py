import pytest

from weftline.operators import search, traverse
from weftline.plans import resolve
from weftline.sources import parsers, project

from . import shop


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    shop.write(root)
    files = project.scan(spark, str(root)).cache()
    facts = parsers.facts(files)
    return files, facts, resolve.build(facts)


def test_scan(built):
    status = {r.path: r.status for r in built[0].select("path", "status").collect()}
    assert status["bin.java"] == "binary" and status["link.java"] == "symbolic-link" and status["photo.png"] == "unsupported-file-type"
    assert status["docs/readme.md"] == "metadata" and status["web/cart/list.jsp"] == "parsed"
    assert not any(p.startswith(("node_modules", "gen/")) for p in status)


def test_properties_and_fields(built):
    rows = built[1].collect()
    own = [(r.data["key"], r.data["value"]) for r in rows if r.kind == "property"]
    assert own == [("title", "Shop front"), ("key one", "vAl"), ("empty", "")]
    fields = {r.data["name"]: r.data for r in rows if r.kind == "field"}
    assert fields["cartId"]["url"] == "/cart.do" and fields["cartId"]["default"] == "7" and fields["loose"]["form"] == "" and len(fields) == 3
    assert {r.data["code"] for r in rows if r.kind == "warning"} >= {"dynamic-field", "unclosed-root"}


def test_chain_from_page_to_table(built):
    edges = {(r.source, r.type, r.target): r.confidence for r in built[2].edges.collect()}
    chain = [
        ("page:/cart/list.jsp", "submits_to", "route:/cart.do"),
        ("route:/cart.do", "maps_to", "java_type:com.shop.CartAction"),
        ("route:/cart.do", "dispatches_to", "java_method:com.shop.CartAction#save/4"),
        ("route:/cart.do", "dispatches_to", "java_method:com.shop.BaseAction#drop/4"),
        ("java_method:com.shop.CartAction#save/4", "calls", "java_method:com.shop.service.CartService#store/1"),
        ("java_method:com.shop.service.CartService#store/1", "implemented_by", "java_method:com.shop.service.CartServiceImpl#store/1"),
        ("java_method:com.shop.service.CartServiceImpl#store/1", "calls", "java_method:com.shop.dao.CartDao#write/1"),
        ("java_method:com.shop.service.CartServiceImpl#store/1", "calls", "java_method:com.shop.service.Tidier#tidy/0"),
        ("java_method:com.shop.dao.CartDao#write/1", "uses_statement", "statement:cart.save"),
        ("java_method:com.shop.dao.CartDao#write/1", "uses_statement", "statement:cart.load"),
        ("statement:cart.save", "writes_to", "table:dbo.cart"),
        ("statement:cart.save", "reads_from", "table:stock"),
        ("statement:cart.load", "reads_from", "table:cart"),
        ("statement:cart.sync", "calls_procedure", "procedure:dbo.synccart"),
        ("procedure:dbo.synccart", "writes_to", "table:audit"),
        ("procedure:dbo.synccart", "calls", "procedure:notify"),
        ("page:/cart/list.jsp", "requests", "route:/api/stock"),
        ("route:/api/stock", "maps_to", "java_type:com.shop.StockServlet"),
        ("route:/api/*", "maps_to", "java_type:com.shop.StockServlet"),
        ("route:/api/stock", "dispatches_to", "java_method:com.shop.StockServlet#doGet/2"),
        ("route:/api/stock", "dispatches_to", "java_method:com.shop.StockServlet#doPost/2"),
        ("page:/cart/list.jsp", "links_to", "route:/cart/help.do"),
        ("route:/cart/help.do", "maps_to", "java_type:com.shop.HelpController"),
        ("route:/cart/help.do", "dispatches_to", "java_method:com.shop.HelpController#handleRequest/2"),
        ("page:/cart/list.jsp", "loads_script", "file:web/js/cart.js"),
        ("route:/cart.do", "forwards_to", "page:/cart/done.jsp"),
        ("route:/cart.do", "uses_tile", "tiles_definition:shop.main"),
        ("tiles_definition:shop.main", "extends_tile", "tiles_definition:base"),
        ("tiles_definition:base", "uses_template", "page:/layout.jsp"),
    ]
    assert [c for c in chain if c not in edges] == []
    assert edges["java_method:com.shop.dao.CartDao#write/1", "uses_statement", "statement:cart.load"] == 0.95
    assert not any("hidden" in t or "nowhere" in t or "fake" in t or "gone" in t for _, _, t in edges)
    assert {r.code for r in built[2].warnings.collect()} == {"unresolved-statement", "unresolved-entry", "unresolved-class", "unclosed-root", "dynamic-field"}


def test_graph_is_valid_and_traced(built):
    graph = built[2]
    assert resolve.problems(graph.nodes, graph.edges).collect() == []
    found = search.starts(graph.nodes, "Cart & Totals").collect()
    assert [r.id for r in found] == ["page:/cart/list.jsp"]
    _, direction, types = traverse.MODES["feature"]
    trace = traverse.traverse(graph.edges, [found[0].id], direction, types, ends=graph.nodes.where("type = 'table'").select("id"))
    assert "table:dbo.cart" in trace.nodes and not trace.truncated
    up = traverse.traverse(graph.edges, ["table:dbo.cart"], "incoming", traverse.MODES["table"][2])
    assert "page:/cart/list.jsp" in up.nodes
    classes = {r.edge.split("|")[2]: r.classification for r in resolve.confirmed_outcomes(graph, built[1]).collect()}
    # the route enters two methods, so no outcome is certain
    assert classes["page:/cart/done.jsp"] == "configured-candidate" and classes["tiles_definition:shop.main"] == "configured-candidate"


def test_cache_reuses_unchanged_files(built):
    files, facts, _ = built
    todo, live = project.split_by_cache(files.where("status = 'parsed'"), facts.where("path <> 'db/procs.sql'"), parsers.VERSION)
    assert {r.path for r in todo.select("path").collect()} == {"db/procs.sql"}
    assert live.count() == facts.where("path <> 'db/procs.sql'").count()
    assert project.split_by_cache(files, None, "1")[1] is None


def test_bad_parser_is_isolated(built):
    def broken(text):
        raise ValueError("at /secret/place/file.java")

    rows = parsers.facts(built[0], parsers.PARSERS | {"sql": broken}).collect()
    bad = [r for r in rows if r.kind == "error"]
    assert len(bad) == 1 and "<path>" in bad[0].data["message"] and any(r.kind == "java_type" for r in rows)


def test_resolution_rules(spark, tmp_path):
    """Names, dispatch and templates, on a tree made for them."""
    java = {
        "p/Outer": "package p;\nimport q.Other;\nimport w.*;\npublic class Outer {\n  private Inner inner; private Other.Part part; private Wild wild; private p.Same same;\n  public void run() { inner.go(); part.go(); wild.go(); same.go(); missing.only(); }\n  public static class Inner { public void go() { } }\n}",
        "q/Other": "package q;\npublic class Other { public static class Part { public void go() { } } public static class Inner { public void go() { } } }",
        "w/Wild": "package w;\npublic class Wild { public void go() { } public void only() { } }",
        "p/Same": "package p;\npublic class Same { public void go() { } }",
        "a/Base": "package a;\npublic class Base {\n  public ActionForward execute(ActionMapping m, ActionForm f, HttpServletRequest q, HttpServletResponse r) { return doExecute(m, f, q, r); }\n  protected ActionForward doExecute(ActionMapping m, ActionForm f, HttpServletRequest q, HttpServletResponse r) { return null; }\n}",
        "a/Child": "package a;\npublic class Child extends Base {\n  protected ActionForward doExecute(ActionMapping m, ActionForm f, HttpServletRequest q, HttpServletResponse r) { return m.findForward(\"ok\"); }\n}",
        "a/Many": "package a;\npublic class Many extends MyDispatchAction {\n  public ActionForward execute(ActionMapping m, ActionForm f, HttpServletRequest q, HttpServletResponse r) { return null; }\n  public ActionForward pick(ActionMapping m, ActionForm f, HttpServletRequest q, HttpServletResponse r) { return null; }\n  public ActionForward hidden(String no) { return null; }\n}",
        "a/Two": "package a;\npublic class Two { public String execute() { return \"done\"; } public String other(int no) { return null; } }",
    }
    for name, text in java.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"src/{name}.java").write_text(text)
    (tmp_path / "struts-config.xml").write_text('<struts-config><action path="/child" type="a.Child"><forward name="ok" path="/ok.jsp"/></action><action path="/many" type="a.Many" parameter="do"/><action path="/none" type="no.Such"/></struts-config>')
    (tmp_path / "struts.xml").write_text('<struts><package namespace="/s"><action name="two" class="a.Two"><result name="done">/done.jsp</result></action></package></struts>')
    (tmp_path / "beans.xml").write_text('<beans><bean id="b" class="a.Two"/><bean id="b" class="a.Many"/><bean class="x.SimpleUrlHandlerMapping"><property name="mappings"><props><prop key="/bean.do">c</prop></props></property></bean></beans>')
    (tmp_path / "more.xml").write_text('<struts-config><action path="/amb" type="b"/></struts-config>')
    (tmp_path / "p.jsp").write_text('<a href="/many.do?do=pick">x</a><a href="/many.do?do=${y}">y</a><a href="/many.do?do=hidden">z</a>')
    facts = parsers.facts(project.scan(spark, str(tmp_path)))
    graph = resolve.build(facts)
    rows = graph.edges.collect()
    calls = {(r.source, r.target, r.confidence) for r in rows if r.type == "calls"}
    run = "java_method:p.Outer#run/0"
    assert {c for c in calls if c[0] == run} == {(run, f"java_method:{t}", c) for t, c in (("p.Outer$Inner#go/0", 0.9), ("q.Other$Part#go/0", 0.9), ("w.Wild#go/0", 0.9), ("p.Same#go/0", 0.9), ("w.Wild#only/0", 0.5))}
    entries = {(r.source, r.target.split(":")[1], r.reason, r.confidence) for r in rows if r.type == "dispatches_to"}
    assert entries == {
        ("route:/child.do", "a.Base#execute/4", "Inherited Action entry convention", 0.9),
        ("route:/child.do", "a.Child#doExecute/4", "Action template handler via inherited execute", 0.9),
        ("route:/many.do", "a.Many#pick/4", "Struts parameter do", 1.0),
        ("route:/s/two.action", "a.Two#execute/0", "Action entry convention", 0.9),
    }
    assert {(r.code, r.subject) for r in graph.warnings.collect()} == {("unresolved-class", "/none.do no.Such"), ("ambiguous-bean", "/amb.do b"), ("unresolved-class", "/bean.do c")}
    found = {r.edge.split("|")[2]: r.classification for r in resolve.confirmed_outcomes(graph, facts).collect()}
    assert found["page:/done.jsp"] == "code-confirmed" and found["page:/ok.jsp"] == "configured-candidate"
    assert resolve.problems(graph.nodes, graph.edges).collect() == []
