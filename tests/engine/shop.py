"""A small web application with every kind of source; written for these tests."""

FILES = {
    "web/cart/list.jsp": """<%@ include file="/common/head.jsp" %>
<html><!-- <form action="/gone.do"> --><body>
<h1>Cart &amp; Totals</h1>
<form action="${pageContext.request.contextPath}/cart.do?method=save" method="post">
  <input type="hidden" name="cartId" value="7"/><input name="${dyn}"/><select name="size"></select>
</form>
<input form="other" name="loose"/>
<a href="help.do">Help</a>
<script src="../js/cart.js"></script>
<script>fetch('/api/stock', {method: 'GET'}); $.ajax({url: "/cart.do?method=drop", type: 'POST'});</script>
</body></html>
""",
    "web/js/cart.js": "// fetch('/no.do')\nvar r = new XMLHttpRequest();\nr.open('POST', '/api/stock');\n",
    "WEB-INF/struts-config.xml": """<struts-config><action-mappings>
<action path="/cart" type="com.shop.CartAction" name="cartForm" parameter="method">
  <forward name="done" path="/cart/done.jsp"/><forward name="main" path="shop.main"/>
</action></action-mappings></struts-config>
""",
    "WEB-INF/tiles.xml": """<tiles-definitions>
<definition name="base" template="/layout.jsp"><put name="menu" value="/menu.jsp"/></definition>
<definition name="shop.main" extends="base"><put name="body" value="/cart/body.jsp"/></definition>
</tiles-definitions>
""",
    "WEB-INF/web.xml": """<web-app><servlet><servlet-name>api</servlet-name><servlet-class>com.shop.StockServlet</servlet-class></servlet>
<servlet-mapping><servlet-name>api</servlet-name><url-pattern>/api/*</url-pattern></servlet-mapping>
<servlet-mapping><servlet-name>none</servlet-name><url-pattern>/none</url-pattern></servlet-mapping></web-app>
""",
    "WEB-INF/beans.xml": """<beans><bean id="helpBean" class="com.shop.HelpController"/>
<bean class="org.springframework.web.servlet.handler.SimpleUrlHandlerMapping"><property name="mappings"><props><prop key="/cart/help.do">helpBean</prop></props></property></bean></beans>
""",
    "src/com/shop/CartAction.java": """package com.shop;
import com.shop.service.CartService;
public class CartAction extends BaseAction {
    private CartService service;
    // service.fake();
    public ActionForward save(ActionMapping mapping, ActionForm form, HttpServletRequest req, HttpServletResponse res) {
        service.store("x { y");
        return mapping.findForward("done");
    }
}
""",
    "src/com/shop/BaseAction.java": """package com.shop;
public class BaseAction {
    public ActionForward drop(ActionMapping m, ActionForm f, HttpServletRequest a, HttpServletResponse b) { return null; }
}
""",
    "src/com/shop/service/CartService.java": "package com.shop.service;\npublic interface CartService {\n    void store(String id);\n}\n",
    "src/com/shop/service/CartServiceImpl.java": """package com.shop.service;
import com.shop.dao.*;
public class CartServiceImpl implements CartService {
    public void store(String id) {
        CartDao dao = new CartDao();
        dao.write(id);
        helper().tidy();
    }
    private Tidier helper() { return null; }
}
class Tidier {
    public void tidy() { }
}
""",
    "src/com/shop/dao/CartDao.java": """package com.shop.dao;
public class CartDao {
    private static final String STATEMENT_LOAD = "cart.load";
    private SqlMapClient sqlMap;
    public void write(String id) {
        sqlMap.update("cart.save", id);
        sqlMap.queryForList(STATEMENT_LOAD, id);
        sqlMap.insert("cart.missing", id);
    }
}
""",
    "src/com/shop/StockServlet.java": """package com.shop;
public class StockServlet {
    protected void doGet(Object a, Object b) { }
    protected void doPost(Object a, Object b) { }
}
""",
    "src/com/shop/HelpController.java": "package com.shop;\npublic class HelpController {\n    public Object handleRequest(Object a, Object b) { return null; }\n}\n",
    "sqlmap/cart.xml": """<sqlMap namespace="cart"><sql id="who">WHERE id = #id#</sql>
<update id="save">UPDATE c SET n = 1 FROM [dbo].[Cart] c JOIN stock s ON s.id = c.id <include refid="who"/> -- FROM hidden
</update>
<select id="load"><![CDATA[ SELECT * FROM Cart WHERE a < 'FROM nowhere' ]]></select>
<procedure id="sync">{call dbo.SyncCart(?)}</procedure></sqlMap>
""",
    "db/procs.sql": """CREATE PROCEDURE dbo.SyncCart @id INT, @n INT AS
INSERT INTO audit SELECT * FROM cart
EXEC dbo.Notify
GO
CREATE OR ALTER PROC Notify AS DELETE FROM queue
""",
    "conf/app.properties": "# note\ntitle = Shop \\\n  front\nkey\\ one:v\\u0041l\n!x=1\nempty\n",
    "docs/readme.md": "not parsed",
    "web/bad.xml": "<beans><bean id='x' class='y'>",
}


def write(root) -> None:
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (root / "node_modules").mkdir()
    (root / "node_modules/skip.js").write_text("fetch('/x')")
    (root / "bin.java").write_bytes(b"class A { \0 }")
    (root / "link.java").symlink_to(root / "docs/readme.md")
    (root / "photo.png").write_bytes(b"x")
    (root / "gen").mkdir()
    (root / "gen/out.java").write_text("class Gen { }")
    (root / ".weftignore").write_text("# generated\ngen/\n")
