"""What the parsers read from small sources, and what they leave out."""

from weftline.sources.parsers import java, sql, web, xml
from weftline.sources.parsers.base import Source


def rows(found, kind):
    return [r for r in found.rows if r[0] == kind]


def data(found, kind, *names):
    return [tuple(r[5].get(n) for n in names) for r in rows(found, kind)]


def test_positions_and_back():
    for cr in (False, True):
        s = Source("ab\ncd\r\n😀x\ry\n", cr)
        for at in range(len(s.text)):
            line, column, _ = s.at(at)
            assert s.offset_at(line, column) == at
    assert Source("a\rb").at(2)[:2] == (1, 3) and Source("a\rb", cr=True).at(2)[:2] == (2, 1)
    assert Source("😀x").at(1) == (1, 3, "😀x")


JAVA = """package com.acme;
import a.b.*;
import static c.D.x;
public class Foo<T extends Bar<T>> extends x.y.Base<T> implements A<B, C>, D {
  private static final String SQL_ID = "a.b", OTHER = "c";
  private static final String NAME_OF_QUERY = "n.q";
  private SqlMapClient sqlMap;
  private Map<String, List<X>> held = new HashMap<String, List<X>>();
  @Override public List<String> go(@Q({"a", "b"}) final Map<String , Object> p, int q [], String... r) throws E {
    sqlMap.update(NAME_OF_QUERY, x); sqlMap.insert("lit"); sqlMap.delete(other); plain.update("no");
    getSqlMapClientTemplate().queryForList("t.l");
    helper.a.go("}"); this.getX().run(); foo().bar().baz();
    final List<Foo> l = new ArrayList<Foo>();
    Handler h = new @M Handler<A>() { { helper.no(); } public void z() { Local no; helper.no(); } };
    Runnable r1 = () -> { helper.no(); }, r2 = () -> helper.no();
    Supplier<Pair<A, B>> r3 = () -> new Pair<A, Map<B, C>>(service.no(), helper.<X, Y>no());
    BooleanSupplier r4 = () -> left < right;
    for (int i = 0; i < n; i++) { svc.loop(i); }
    if (a) { svc.first(); } else if (b) { svc.second(); }
    switch (c) { case 1 -> { svc.rule(); } default -> svc.other(() -> { svc.no(); return "no"; }); }
    String block = \"\"\" class No { String s() { return "no"; } } \"\"\";
    return null;
  }
  public Foo(int a) { svc.made(); }
  String value(int c) { switch (c) { case 1 -> { return "a"; } case F ? 3 : 4 -> { return "b"; } default: return "c"; } }
  ActionForward act() { class Loc { String y() { return "loc"; } } if (a) return m.findForward("ok"); return "no"; }
  Object wrong() { return "wrong"; }
}
enum E { A { void q() { svc.no(); } }, B(1); void own() { svc.inEnum(); } }
interface I extends P, Q<R> { void first(String s); String CONST = "k"; class Inner { } }
"""


def test_java_declarations():
    f = java.parse(JAVA)
    assert data(f, "import", "name") == [("a.b.*",), ("c.D.x",)]
    assert data(f, "java_type", "full_name", "extends", "implements", "static_member") == [("com.acme.Foo", "x.y.Base", "A\nD", "false"), (f"com.acme.Foo$local$Loc${JAVA.index('class Loc')}", "", "", "false"), ("com.acme.E", "", "", "false"), ("com.acme.I", "P", "Q", "false"), ("com.acme.I$Inner", "", "", "true")]
    assert data(f, "java_field", "name", "type") == [("SQL_ID", "String"), ("NAME_OF_QUERY", "String"), ("sqlMap", "SqlMapClient"), ("held", "Map<String,List<X>>")]
    assert data(f, "java_method", "owner", "name", "signature", "return_type") == [
        ("com.acme.Foo", "go", "Map<String,Object>,int[],String...", "List<String>"),
        ("com.acme.Foo", "Foo", "int", "public"),
        ("com.acme.Foo", "value", "int", "String"),
        ("com.acme.Foo", "act", "", "ActionForward"),
        (f"com.acme.Foo$local$Loc${JAVA.index('class Loc')}", "y", "", "String"),
        ("com.acme.Foo", "wrong", "", "Object"),
        ("com.acme.E", "own", "", "void"),
        ("com.acme.I", "first", "String", "void"),
    ]
    assert data(f, "java_constant", "name", "value") == [("NAME_OF_QUERY", "n.q"), ("CONST", "k")]


def test_java_uses():
    f = java.parse(JAVA)
    assert [x[0] for x in data(f, "java_local", "name")] == ["l", "h", "r1", "r3", "r4", "i", "block"]
    calls = [f"{r}.{c}" for r, c in data(f, "java_call", "receiver", "called")]
    assert calls == ["sqlMap.update", "sqlMap.insert", "sqlMap.delete", "plain.update", "getSqlMapClientTemplate.queryForList", "helper.a.go", "this.getX", "getX.run", "foo.bar", "svc.loop", "svc.first", "svc.second", "svc.rule", "svc.other", "svc.made", "m.findForward", "svc.inEnum"]
    assert data(f, "java_return", "method", "name", "kind") == [("value", "a", "string-literal"), ("value", "b", "string-literal"), ("value", "c", "string-literal"), ("y", "loc", "string-literal"), ("act", "ok", "find-forward")]
    assert data(f, "statement_use", "operation", "statement", "confidence") == [("update", "n.q", "0.95"), ("insert", "lit", "1.0"), ("delete", "n.q", "0.7"), ("queryForList", "t.l", "1.0")]


def test_java_escapes_keep_raw_positions():
    text = "\\u0020package p;\npublic \\u0063lass A \\u007b\n  String s() { /* \\u0020 */ return \"x\\u0041\"; } // end \\u000a String t() { return \"y\"; }\n  void u() { \\u0061.b(); new Q() { void v() { c.d(); } }; }\n}\n"
    f = java.parse(text)
    assert data(f, "java_type", "full_name") == [("p.A",)] and rows(f, "java_type")[0][2:4] == (2, 8)
    assert data(f, "java_return", "name") == [("xA",), ("y",)]
    raw = text.split("\n")
    assert [r[3] - 1 for r in rows(f, "java_return")] == [raw[2].index("return"), raw[2].index('return "y"')]
    assert data(f, "java_call", "receiver") == [("a",)] and rows(f, "java_call")[0][3] - 1 == raw[3].index("\\u0061")
    # a backslash made by an escape doesn't count; an odd raw one does
    assert java.unescape("\\u005c\\u000a") == "\\\n" and java.unescape("\\\\u000a") == "\\\\u000a" and java.unescape("\\u005c\\\\u000a") == "\\\\\\u000a"


def test_java_lines_may_end_in_carriage_returns():
    f = java.parse("class A {\r  // note\r  String s() {\r    return \"real\";\r  }\r}")
    assert [(r[2], r[3], r[4]) for r in rows(f, "java_return")] == [(4, 5, 'return "real";')]


def test_java_odd_texts():
    for text in ("", "}", "class", "class A", "{{{", '"', "class A { void f( { }", "return", "a -> b", "@", "class A { int x = ", "\\u", "enum E { ,;", "new X(", "case x ->"):
        java.parse(text)
    java.parse("class A { " + "{" * 5000 + "}" * 5000 + " }")


def test_sql_tables():
    assert sql.lineage("UPDATE c SET n = 1 FROM [dbo] . [Cart] AS c JOIN stock s ON s.id = c.id -- FROM hidden\nWHERE x = 'FROM no' /* JOIN no */", "update") == (["stock"], ["dbo.cart"])
    assert sql.lineage("WITH x AS (SELECT * FROM a), z AS (SELECT * FROM x) DELETE t FROM tt AS t JOIN z ON 1 = 1", "delete") == (["a"], ["tt"])
    assert sql.lineage("MERGE INTO tgt USING src s ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1", "update") == (["src"], ["tgt"])
    assert sql.lineage("DELETE FROM q; UPDATE u SET x = 1; DELETE a FROM v a; INSERT INTO w SELECT * FROM r INNER JOIN [a b] ON 1 = 1", "statement") == (["a b", "r"], ["q", "u", "v", "w"])
    assert sql.lineage("INSERT INTO a SELECT * FROM b", "select") == (["b"], []) and sql.lineage("", "statement") == ([], [])
    assert [sql.called(x) for x in ("{call dbo.Sync(?)}", "{ ? = call [p].q }", "exec x", "-- call no\nselect 1")] == ["dbo.sync", "p.q", "x", ""]


def test_sql_procedures():
    text = "CREATE PROCEDURE dbo.SyncCart @id INT,\n @n   INT AS\nINSERT INTO audit SELECT * FROM cart\nEXEC dbo.Notify\nEXEC @rc = other.Proc @a = 1\n  go  \nSELECT * FROM outside\nCREATE OR ALTER PROC Notify AS DELETE FROM queue EXEC (@sql)\nALTER PROC z WITH EXECUTE AS OWNER AS SELECT * FROM t\n"
    f = sql.parse(text)
    assert data(f, "procedure", "full_name", "parameters", "reads", "writes", "calls") == [("dbo.synccart", "@id INT\n@n INT", "cart", "audit", "dbo.notify\nother.proc"), ("notify", "", "", "queue", ""), ("z", "", "t", "", "")]
    assert data(f, "warning", "code") == [("dynamic-procedure",)] and rows(f, "procedure")[1][2] == 8


def test_xml_statements():
    f = xml.parse("""<sqlMap namespace="cart"><sql id="who">WHERE id = #id# <include refid="cart.who"/></sql><!-- <select id="no">FROM no</select> -->
<update id="save">UPDATE c SET n = 1 FROM [dbo].[Cart] c <isNotNull prop="a>b">JOIN stock s</isNotNull> ON 1 = 1 -- FROM hidden
<include refid="who"/> AND x &lt; 1</update>
<select id="load" resultClass="R"><![CDATA[ SELECT * FROM Cart WHERE a < 'FROM nowhere' ]]></select>
<procedure id="sync">{call dbo.SyncCart(?)}</procedure><procedure id="bad">x</procedure><select id="cut">SELECT 1 FROM""")
    assert data(f, "statement", "full_id", "type", "reads", "writes", "procedure") == [("cart.save", "update", "stock", "dbo.cart", ""), ("cart.load", "select", "cart", "", ""), ("cart.sync", "procedure", "", "", "dbo.synccart"), ("cart.bad", "procedure", "", "", "")]
    assert data(f, "statement", "sql")[0][0].endswith("WHERE id = #id# AND x < 1") and data(f, "statement", "includes")[0] == ("who",)
    assert sorted(x[0] for x in data(f, "warning", "code")) == ["unclosed-root", "unresolved-procedure"]


def test_xml_configurations():
    f = xml.parse('<struts><constant name="struts.action.extension" value="x"/><constant name="struts.action.extension" value=".do,action"/><package namespace="/adm/"><action name="go" class="a.B" method="m"><result>/x.jsp</result><result name="r" type="redirectAction"><param name="actionName">next</param></result></action><action name="q.do" class="c"/><action name="none"/></package></struts>')
    assert data(f, "route", "url", "method", "explicit") == [("/adm/go.do", "m", "true"), ("/adm/q.do", "execute", "false")]
    assert data(f, "forward", "url", "name", "path") == [("/adm/go.do", "success", "/x.jsp"), ("/adm/go.do", "r", "/adm/next.do")]
    f = xml.parse('<struts-config><action path="/cart" type="C" parameter="m"><forward name="done" path="/d.jsp"/></action><action path="/a.go" type="x"/><action path="/none"/></struts-config>')
    assert data(f, "route", "url", "target") == [("/cart.do", "C"), ("/a.go", "x")] and data(f, "forward", "name") == [("done",)]
    f = xml.parse('<web-app><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/x/*</url-pattern></servlet-mapping><servlet><servlet-name> s </servlet-name><servlet-class>a.S</servlet-class></servlet><servlet-mapping><servlet-name>t</servlet-name><url-pattern>/t</url-pattern></servlet-mapping></web-app>')
    assert data(f, "route", "url", "target") == [("/x/*", "a.S"), ("/t", "")]
    f = xml.parse('<beans><bean id="b" class="c.D"/><bean class="o.SimpleUrlHandlerMapping"><property name="mappings"><map><entry key="/m" value-ref="b"/></map><props><prop key="/p">b</prop><prop key="no">b</prop></props></property></bean><bean id="fake" class="X"><property name="mappings"><props><prop key="/f">b</prop></props></property></bean></beans>')
    assert data(f, "route", "url", "target") == [("/m", "c.D"), ("/p", "c.D")]
    f = xml.parse('<tiles-definitions><definition name="a" template="/t.jsp"><put name="x" value="/x.jsp"/><put-attribute name="y">words</put-attribute></definition><definition extends="a"/></tiles-definitions>')
    assert data(f, "tile", "name", "template") == [("a", "/t.jsp")] and data(f, "put", "name", "value") == [("x", "/x.jsp"), ("y", "words")]
    for odd in ("", "<", "<a", "</a>", "<beans", "<beans><bean", "<!-- x", "<![CDATA[ y", "<a><b></a></b>"):
        xml.parse(odd)
    assert [x[0] for x in data(xml.parse("<beans><!-- x"), "warning", "code")] == ["unclosed-root", "unclosed-section"]


def test_scripts():
    text = """// fetch('/no.do') http://x
var s = "fetch('/no2.do')"; var r = /fetch('\\/no3')/g; x = a / b; /* fetch('/no4') */
fetch('/a?x=1', {method: 'POST', headers: {method: "PUT"}}); window.fetch("/b"); fetch(url); fetch('/c' + x);
xhr.open('PUT', '/d', true); $.ajax({url: "/e", ...more}); jQuery.ajax({...o, url: "/f", type: "post"}); $.ajax({"url": '/g', method: m});
fetch(`/t`); fetch(`/${t}`); fetch('http://ext/x'); function fetch(a) {} fetch('/h', {...o});
"""
    f = web.parse_script(text)
    assert data(f, "request", "kind", "url", "method") == [("fetch", "/a", "POST"), ("fetch", "/b", "GET"), ("xhr", "/d", "PUT"), ("ajax", "/f", "POST"), ("ajax", "/g", ""), ("fetch", "/t", "GET"), ("fetch", "/h", "")]
    for odd in ("", "/", "fetch(", "fetch('", "$.ajax({", "`", "a/", "'\\", "//", "/*"):
        web.parse_script(odd)


def test_entities():
    assert web.decoded("&amp;&#65;&#x42;&nbsp;&#0;&#xD800;&LT;&copy;&#1114112;") == "&AB&nbsp;\ufffd\ufffd<&copy;\ufffd"
