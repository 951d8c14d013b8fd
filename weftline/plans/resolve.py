"""From facts to a property graph: nodes, edges with confidence and reason, warnings. Every step is a join.

Files to facts is the expensive part and runs once per changed file; facts are small beside the
sources. Reference tables are joined on names, so a shuffle is by name and hot names are only those
that very many places mention; AQE splits such join partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions.scratch import cut
from weftline.operators import match, merge, traverse

EVIDENCE = "array<struct<file:string,line:int,column:int,snippet:string>>"


@dataclass
class Graph:
    nodes: DataFrame  # id, type, name, file_path, evidence, search_text, data
    edges: DataFrame  # id, source, target, type, confidence, reason, evidence
    warnings: DataFrame  # code, subject


#: What a rule finds: a node, an edge or a warning (what: 0, 1, 2).
_FIELDS = {"what": "int", "id": "string", "source": "string", "target": "string", "type": "string", "name": "string", "has_file": "boolean", "confidence": "double", "reason": "string", "search": "array<string>", "data": "map<string,string>"}
# How routes of each kind choose the methods they enter, the entry methods whose inherited form calls a
# template method of the subclass, and the parameters of a Struts 1 entry method.
SERVLET = {"GET": "doGet", "POST": "doPost"}
SPRING_ENTRIES, STRUTS_ENTRIES, STRUTS2_ENTRIES = ("handleRequest", "handleRequestInternal"), ("execute", "perform"), ("execute",)
TEMPLATES = {"execute": "doExecute", "perform": "doPerform"}
STRUTS_SIGNATURE = "ActionMapping,ActionForm,HttpServletRequest,HttpServletResponse"
_PROOF = ("path", "ord", "line", "col", "snippet")


def _kind(facts: DataFrame, kind: str, *fields: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).select(*_PROOF, *(F.coalesce(F.col("data")[f], F.lit("")).alias(f) for f in fields))


def _list(c: str | Column) -> Column:
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, "\n"), lambda v: v != "")


def _tag(kind: str, c: str) -> str:
    return f"concat('{kind}:', {c})"


def _record(**given: str) -> str:
    """A record as an SQL expression of its fields' expressions."""
    return f"named_struct({', '.join(f"'{k}', cast({given.get(k, 'null')} as {t})" for k, t in _FIELDS.items())})"


def _edge(source: str, target: str, kind: str, confidence: str | float = 1.0, reason: str = "''") -> str:
    """An edge; kind is a type or, with a blank in it, an expression."""
    return _record(what="1", source=source, target=target, type=kind if " " in kind else f"'{kind}'", confidence=str(confidence), reason=reason)


def _node(kind: str, key: str, name: str | None = None, search: str | None = None, data: str | None = None, file: bool = True) -> str:
    name = name or key
    return _record(what="0", id=_tag(kind, key), type=f"'{kind}'", name=name, has_file=str(file).lower(), search=search or f"array({name})", data=data or "map()")


def _warning(code: str, *subject: str) -> str:
    return _record(what="2", id=f"'{code}'", name=f"concat_ws(' ', {', '.join(subject)})")


def _if(condition: str, record: str, other: str = "null") -> str:
    return f"if({condition}, {record}, {other})"


def _emit(df: DataFrame, *found: str) -> DataFrame:
    """All that a frame's rows give, at once; nulls are nothing."""
    return df.selectExpr("path", "ord", f"cast(array(named_struct('file', path, 'line', line, 'column', col, 'snippet', snippet)) as {EVIDENCE}) as evidence", f"inline(array_compact(array({', '.join(found)})))")


def named_types(refs: DataFrame, types: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref, name, path, owner) with the types that each name means: (ref, full_name, tier). The first tier that has a match decides.

    files: path, package, imports. Tiers: full name, canonical name, a member of the owner or of a type
    around it, explicit import, same package, wildcard imports, any top-level type of the simple name. All
    names that a reference may mean are keys of one join.
    """
    name = tx.type_name(F.col("name"))
    known = types.select("full_name", F.explode(F.array_compact(F.array(F.struct(F.lit("f").alias("by"), F.col("full_name").alias("key")), F.when(F.col("canonical") != "", F.struct(F.lit("c").alias("by"), F.col("canonical").alias("key"))), F.when(F.col("top_level") == "true", F.struct(F.lit("s").alias("by"), F.col("name").alias("key")))))).alias("k")).select("full_name", "k.*")
    plain = refs.withColumn("_n", name).where("_n <> ''").join(files.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left")
    key = lambda tier, by, c: F.struct(F.lit(float(tier)).alias("tier"), F.lit(by).alias("by"), c.alias("key"))
    both = lambda tier, c: [key(tier, "c", c), key(tier + 0.5, "f", c)]
    n, root = F.col("_n"), F.split("_n", r"\.")[0]
    imports = F.coalesce("imports", F.array().cast("array<string>"))
    chosen = F.get(F.filter(imports, lambda i: F.endswith(i, F.concat(F.lit("."), root))), F.lit(0))
    rest = F.substring(n, F.length(root) + 1, F.length(n))
    wild = F.transform(F.filter(imports, lambda i: F.endswith(i, F.lit(".*"))), lambda i: F.concat(F.substring(i, F.lit(1), F.length(i) - 1), n))
    # types around the owner, nearest first: cut its name at each mark of a member
    owner = F.regexp_replace(F.coalesce("owner", F.lit("")), r"\$(?:local|nested)\$.*$", "")
    parts = F.split(owner, r"\$")
    around = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct((2 + i / 1000).cast("double").alias("tier"), F.lit("c").alias("by"), F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "."), F.lit("."), n).alias("key")))
    keys = F.concat(
        F.array(key(0, "f", n), key(1, "c", n), *both(3, F.concat(chosen, rest)), *both(4, F.concat(F.when(F.col("package") != "", F.col("package")), F.lit("."), n)), key(6, "s", tx.simple_name(F.col("name")))),
        around,
        F.flatten(F.transform(wild, lambda w: F.array(*both(5, w)))),
    )
    wanted = plain.select("ref", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k")).select("ref", "k.*")
    return match.first_tier(wanted.join(known, ["by", "key"]).select("ref", "full_name", "tier"), "ref").distinct()


def tiered_names(refs: DataFrame, known: DataFrame, full: str, short: str) -> DataFrame:
    """refs (ref, name) with targets by full name (1.0), else by short name: 0.8 for one, 0.5 for several."""
    keys = known.select(F.col(full).alias("target"), F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col(full).alias("key")), F.struct(F.lit(1).alias("tier"), F.col(short).alias("key")))).alias("k")).select("target", "k.*").distinct()
    wanted = refs.select("ref", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("name").alias("key")), F.struct(F.lit(1).alias("tier"), F.element_at(F.split("name", r"\."), -1).alias("key")))).alias("k")).select("ref", "k.*").distinct()
    found = match.first_tier(wanted.join(keys, ["tier", "key"]).select("ref", "target", "tier"), "ref")
    return found.withColumn("confidence", match.confidence(F.count(F.lit(1)).over(W.partitionBy("ref")), F.col("tier") == 0)).drop("tier")


def build(facts: DataFrame) -> Graph:
    """The graph of all facts: what rules find is written once as records, then merged to nodes and edges."""
    facts = cut(facts.sortWithinPartitions("kind"))
    types = cut(merge.last_wins(_kind(facts, "java_type", "kind", "name", "full_name", "canonical", "package", "top_level", "static_member", "extends", "implements"), ["full_name"], ["path", "ord"]))
    methods = _kind(facts, "java_method", "owner", "name", "visibility", "return_type", "parameters", "types", "arity", "signature").where("owner <> ''")
    overloads = F.count(F.lit(1)).over(W.partitionBy("owner", "name", "arity"))
    key = F.concat(F.col("owner"), F.lit("#"), F.col("name"), F.lit("/"), F.col("arity"), F.when(overloads > 1, F.concat(F.lit("("), "signature", F.lit(")"))).otherwise(""))
    methods = cut(methods.withColumn("method_id", F.concat(F.lit("java_method:"), key)))
    statements = merge.last_wins(_kind(facts, "statement", "id", "full_id", "type", "sql", "reads", "writes", "procedure"), ["full_id"], ["path", "ord"])
    procedures = merge.last_wins(_kind(facts, "procedure", "name", "full_name", "reads", "writes", "calls"), ["full_name"], ["path", "ord"])
    beans = _kind(facts, "bean", "id", "target")
    routes = _kind(facts, "route", "url", "target", "source", "parameter", "method", "explicit", "bean").withColumn("rt", F.concat_ws("\1", "path", "ord"))
    out: list[DataFrame] = []

    # one resolution of all type names: parents, receivers of calls, targets of routes
    supers = types.select(*_PROOF, "full_name", F.explode(F.concat(F.transform(_list("implements"), lambda t: F.struct(F.lit("implements").alias("how"), t.alias("sup"))), F.filter(F.array(F.struct(F.lit("extends").alias("how"), F.col("extends").alias("sup"))), lambda x: x["sup"] != ""))).alias("s")).select("*", "s.*").drop("s").withColumn("ref", F.concat_ws("\1", "full_name", "how", "sup"))
    call = _kind(facts, "java_call", "owner", "method", "arity", "signature", "receiver", "receiver_method", "called").withColumn("ref", F.concat_ws("\1", "path", "ord")).withColumn("pos", F.col("line") * 100_000 + F.col("col"))
    local = _kind(facts, "java_local", "owner", "method", "arity", "signature", "name", "type").select("owner", "method", "arity", "signature", F.col("name").alias("receiver"), (F.col("line") * 100_000 + F.col("col")).alias("decl"), F.col("type").alias("local_type"))
    field = merge.last_wins(_kind(facts, "java_field", "owner", "name", "type"), ["owner", "name"], ["path", "ord"]).select("owner", F.col("name").alias("receiver"), F.col("type").alias("field_type"))
    getter = methods.where("arity = '0'").select("owner", F.col("name").alias("receiver_method"), F.col("return_type").alias("getter_type"))
    # a receiver's type is that of the latest local declaration before the call, else of the field, else what a getter returns
    typed = match.as_of(call, local, ["owner", "method", "arity", "signature", "receiver"], "pos", "decl", ["local_type"]).join(field, ["owner", "receiver"], "left").join(getter, ["owner", "receiver_method"], "left")
    typed = cut(typed.withColumn("name", F.when(F.col("receiver_method") != "", F.col("getter_type")).otherwise(F.coalesce("local_type", "field_type", F.when(F.col("receiver") == "this", F.col("owner"))))))
    named = beans.groupBy("id").agg(F.count_distinct("target").alias("n_classes"), F.min("target").alias("bean_class"))
    asked_class = F.when(F.col("target") != "", F.col("target")).otherwise(F.col("bean"))
    by_bean = cut(routes.withColumn("cls", asked_class).join(named, F.col("cls") == F.col("id"), "left").drop("id"))
    none = F.lit("")
    refs = supers.select("ref", F.col("sup").alias("name"), "path", F.col("full_name").alias("owner"), F.lit("super").alias("of"))
    refs = refs.unionByName(typed.where("name is not null").select("ref", "name", "path", "owner", F.lit("call").alias("of")))
    refs = refs.unionByName(by_bean.select("rt", F.explode(F.array_compact(F.array(F.struct(F.col("cls").alias("name"), F.lit("direct").alias("of")), F.when(F.col("n_classes") == 1, F.struct(F.col("bean_class").alias("name"), F.lit("bean").alias("of")))))).alias("x")).select(F.col("rt").alias("ref"), "x.name", none.alias("path"), none.alias("owner"), "x.of"))
    files = facts.where("kind in ('java_type', 'import')").groupBy("path").agg(F.max(F.col("data")["package"]).alias("package"), F.array_sort(F.collect_set(F.when(F.col("kind") == "import", F.col("data")["name"]))).alias("imports"))
    keyed = refs.withColumn("ref", F.concat_ws("\2", "of", "ref"))
    means = cut(named_types(keyed, types, files).join(keyed.select("ref", F.col("name").alias("asked")).distinct(), "ref").select(F.split("ref", "\2")[0].alias("of"), F.split("ref", "\2")[1].alias("ref"), "full_name", "tier", "asked"))

    # types, methods, their ties
    file_of = lambda target: _edge(_tag("file", "path"), target, "contains", 1.0, "'file'")
    out.append(_emit(types, _node("java_type", "full_name", search="array(name)", data="map('extendsType', extends)"), file_of(_tag("java_type", "full_name"))))
    out.append(_emit(methods, _record(what="0", id="method_id", type="'java_method'", name="concat(owner, '.', name)", has_file="true", search="array(name)", data="map('returnType', return_type)"), _edge(_tag("java_type", "owner"), "method_id", "declares", 1.0, "'declaration'")))
    sure = F.when(F.count(F.lit(1)).over(W.partitionBy("ref")) == 1, 1.0).otherwise(0.5)
    parents = cut(supers.join(means.where("of = 'super'").select("ref", F.col("full_name").alias("super")).withColumn("sure", sure), "ref"))
    impl = parents.where("how = 'implements'")
    out.append(_emit(impl, _edge(_tag("java_type", "full_name"), _tag("java_type", "super"), "implements", "sure", "'declared'"), _edge(_tag("java_type", "super"), _tag("java_type", "full_name"), "implemented_by", "sure", "'declared'")))
    m = methods.select(F.col("owner").alias("super"), "name", "arity", F.col("signature").alias("ms"), F.col("method_id").alias("mid"), *_PROOF)
    pair = m.join(impl.select("full_name", "super", "sure"), "super").join(methods.select(F.col("owner").alias("full_name"), "name", "arity", "signature", F.col("method_id").alias("iid")), ["full_name", "name", "arity"])
    rank = F.when(F.col("ms") == F.col("signature"), 0).when(tx.signature_simple(F.col("ms")) == tx.signature_simple(F.col("signature")), 1)
    own = W.partitionBy("mid", "full_name")
    pair = pair.withColumn("r", rank).where("r is not null").withColumn("best", F.min("r").over(own)).where("r = best").withColumn("k", F.count(F.lit(1)).over(own)).where("r = 0 or k = 1")
    out.append(_emit(pair, _edge("mid", "iid", "implemented_by", "sure", "'interface method'")))

    # statements, procedures, tables
    for df, kind, full, search, data in ((statements, "statement", "full_id", "array(sql)", "map('type', type)"), (procedures, "procedure", "full_name", "array(name)", None)):
        out.append(_emit(df, _node(kind, full, search=search, data=data), file_of(_tag(kind, full))))
        hit = df.selectExpr(*_PROOF, full, "inline(concat(transform(filter(split(reads, '\\n'), t -> t <> ''), t -> struct('reads_from' as how, t as table)), transform(filter(split(writes, '\\n'), t -> t <> ''), t -> struct('writes_to' as how, t as table))))")
        out.append(_emit(hit, _node("table", "table", file=False), _edge(_tag(kind, full), _tag("table", "table"), "how || ''", 1.0, "'sql'")))
    wants = statements.where("procedure <> ''").select(*_PROOF, F.expr(_tag("statement", "full_id")).alias("owner"), F.col("procedure").alias("name"), F.lit("calls_procedure").alias("how"))
    wants = wants.unionByName(procedures.select(*_PROOF, F.expr(_tag("procedure", "full_name")).alias("owner"), F.explode(_list("calls")).alias("name"), F.lit("calls").alias("how"))).withColumn("ref", F.concat_ws("\1", "owner", "name"))
    got = tiered_names(wants.select("ref", "name"), procedures, "full_name", "name")
    asked = wants.join(got, "ref", "left")
    out.append(_emit(asked, _if("target is null", _warning("unresolved-procedure", "owner", "name"), _edge("owner", _tag("procedure", "target"), "how || ''", "confidence", "'procedure name'"))))

    # uses of statements by methods
    here = methods.select("owner", F.col("name").alias("method"), "arity", "signature", "method_id")
    uses = _kind(facts, "statement_use", "owner", "method", "arity", "signature", "statement", "confidence").withColumnRenamed("confidence", "sure").join(here, ["owner", "method", "arity", "signature"]).withColumn("ref", F.col("statement"))
    got = tiered_names(uses.select("ref", F.col("statement").alias("name")), statements, "full_id", "id")
    uses = uses.join(got, "ref", "left")
    out.append(_emit(uses, _if("target is null", _warning("unresolved-statement", "method_id", "statement"), _edge("method_id", _tag("statement", "target"), "uses_statement", "least(confidence, cast(sure as double))", "'statement id'"))))

    # calls between methods: by the receiver's type, else by a name that one method alone has
    callee = methods.select(F.col("owner").alias("full_name"), F.col("name").alias("called"), F.col("method_id").alias("callee"))
    hit = means.where("of = 'call'").select("ref", "full_name").join(typed.select("ref", "called"), "ref").join(callee, ["full_name", "called"]).select("ref", "callee", F.lit(0).alias("tier"))
    single = callee.groupBy("called").agg(F.count(F.lit(1)).alias("n"), F.min("callee").alias("callee")).where("n = 1").drop("n")
    found = match.first_tier(hit.unionByName(typed.select("ref", "called").join(single, "called").select("ref", "callee", F.lit(1).alias("tier"))), "ref")
    calls = typed.join(found, "ref").join(here.withColumnRenamed("method_id", "caller"), ["owner", "method", "arity", "signature"]).where("caller <> callee")
    out.append(_emit(calls, _edge("caller", "callee", "calls", "if(tier = 0, 0.9, 0.5)", "if(tier = 0, 'receiver type', 'only method of that name')")))

    # pages, their scripts and requests
    is_page, is_script = F.col("path").rlike("(?i)[.]jspx?$"), F.col("path").rlike("(?i)[.]m?js$")
    page = tx.web_path(F.col("path"))
    all_files = facts.groupBy("path").agg(F.max(F.when(F.col("kind") == "text", F.col("data")["text"])).alias("words"))
    all_files = all_files.withColumns({"ord": F.lit(-1), "line": F.lit(1), "col": F.lit(1), "snippet": F.lit(""), "page": F.when(is_page, page), "texts": F.coalesce(_list("words"), F.array().cast("array<string>"))})
    out.append(_emit(all_files, _node("file", "path"), _if("page is not null", _node("page", "page", search="texts")), _if("page is not null", file_of(_tag("page", "page")))))
    loads = facts.where("kind = 'script'").select(*_PROOF, F.col("data")["path"].alias("to")).withColumn("page", page).withColumn("script", tx.url_resolved(F.col("page"), F.col("to")))
    scripts = facts.where(is_script).select(F.col("path").alias("file")).distinct().withColumn("script", tx.web_path(F.col("file")))
    loaded = loads.join(scripts, "script", "left")
    out.append(_emit(loaded, _if("file is null", _warning("unresolved-script", "page", "script"), _edge(_tag("page", "page"), _tag("file", "file"), "loads_script", 1.0, "'script tag'"))))
    requests = _kind(facts, "request", "kind", "url", "method", "query")
    asks = requests.where(is_page).withColumn("page", page).withColumn("from", F.expr(_tag("page", "page")))
    asks = asks.unionByName(requests.where(is_script).join(loaded.where("file is not null").select(F.col("file").alias("path"), "page").distinct(), "path", "left").withColumn("from", F.expr(_tag("file", "path"))))
    asks = cut(asks.withColumn("route", F.coalesce(tx.url_resolved(F.col("page"), F.col("url")), F.col("url"))))
    how = "case kind when 'form' then 'submits_to' when 'link' then 'links_to' else 'requests' end"
    out.append(_emit(asks, _node("route", "route"), _edge("from", _tag("route", "route"), how, 1.0, "concat_ws(' ', kind, method)")))
    inc = facts.where("kind = 'include'").select(*_PROOF, F.col("data")["path"].alias("to")).withColumn("page", page).withColumn("part", tx.url_resolved(F.col("page"), F.col("to"))).where("part is not null")
    out.append(_emit(inc, _node("page", "part", file=False), _edge(_tag("page", "page"), _tag("page", "part"), "includes", 1.0, "'include'")))

    # routes: every route that a target's pattern covers maps to the target's class
    out.append(_emit(beans, _node("spring_bean", "id", search="array(target)")))
    out.append(_emit(by_bean, _node("route", "url", data="map('source', source)"), file_of(_tag("route", "url"))))
    kinds = types.where("kind = 'class'").select("full_name", "top_level", "static_member", "extends")
    goal = means.where("of in ('direct', 'bean') and (tier = 0 or instr(asked, '.') = 0)").join(kinds, "full_name").where("top_level = 'true' or (static_member = 'true' and tier = 0)")
    goal = match.first_tier(goal.select(F.col("ref").alias("rt"), "full_name", "extends", F.col("asked").alias("cls_used"), F.when(F.col("of") == "direct", 0).otherwise(1).alias("tier")), "rt").drop("tier")
    named_routes = asks.select("route").union(by_bean.select("url")).distinct().withColumnRenamed("route", "url")
    covered = match.prefix_routes(named_routes, by_bean.select(F.col("url").alias("pattern")).distinct()).select(F.col("url").alias("route"), "pattern")
    targets = by_bean.join(goal, "rt", "left")
    out.append(_emit(targets.where("full_name is null"), _if("n_classes > 1", _warning("ambiguous-bean", "url", "cls"), _warning("unresolved-class", "url", "cls"))))
    mapped = targets.where("full_name is not null").join(covered, F.col("url") == F.col("pattern")).drop("pattern")
    hints = asks.select("route", F.col("method").alias("verb"), "query").distinct()
    value = F.expr("str_to_map(coalesce(query, ''), '&', '=')[parameter]")
    value = F.when((F.col("parameter") != "") & (value != "") & ~F.contains(value, F.lit("${")), value)
    entered = mapped.join(hints, "route", "left").groupBy("route", "rt", "full_name").agg(*(F.first(c).alias(c) for c in (*_PROOF, "url", "source", "parameter", "method", "explicit", "extends", "cls_used", "n_classes")), F.array_sort(F.collect_set(value)).alias("wanted"), F.array_sort(F.collect_set("verb")).alias("verbs"))
    one = lambda *names: F.array(*(F.lit(n) for n in names))
    by_verb = F.transform("verbs", lambda v: F.coalesce(*(F.when(v == k, e) for k, e in SERVLET.items()), F.lit("service")))
    rules = [
        (F.col("explicit") == "true", F.array("method"), F.lit("Struts 2 action method")),
        (F.size("wanted") > 0, F.col("wanted"), F.concat(F.lit("Struts parameter "), "parameter")),
        ((F.col("source") == "servlet") & (F.size("verbs") > 0), F.array_distinct(by_verb), F.lit("Servlet HTTP method")),
        (F.col("source") == "servlet", one("service"), F.lit("Servlet service convention")),
        (F.col("source") == "spring", one(*SPRING_ENTRIES), F.lit("Spring legacy controller convention")),
        (F.col("extends").endswith("DispatchAction"), F.array().cast("array<string>"), F.lit("")),
        (F.col("source") == "struts2", one(*STRUTS2_ENTRIES), F.lit("Action entry convention")),
        (F.lit(True), one(*STRUTS_ENTRIES), F.lit("Action entry convention")),
    ]
    entered = cut(entered.withColumns({"entries": F.coalesce(*(F.when(when, names) for when, names, _ in rules)), "reason": F.coalesce(*(F.when(when, why) for when, _, why in rules))}))
    out.append(_emit(entered, _edge(_tag("route", "route"), _tag("java_type", "full_name"), "maps_to", "if(cls_used = full_name, 1.0, 0.8)", "source")))
    certain = (F.col("explicit") == "true") | F.array_contains("wanted", F.col("name"))
    entry = entered.select(*_PROOF, "route", "full_name", "source", "reason", "explicit", "wanted", F.explode("entries").alias("name")).withColumn("sure", F.when(certain, 1.0).otherwise(0.9))
    accepted = F.when(F.col("source") == "struts", (F.col("visibility") == "public") & (tx.simple_name(F.col("return_type")) == "ActionForward") & (tx.signature_simple(F.col("signature")) == STRUTS_SIGNATURE)).when(F.col("source") == "struts2", (F.col("visibility") == "public") & (F.col("arity") == "0")).otherwise(True)
    by_owner = methods.select(F.col("owner").alias("full_name"), "name", "visibility", "return_type", "signature", "arity", "method_id")
    direct = entry.join(by_owner, ["full_name", "name"]).where(accepted)
    rest = cut(entry.join(direct.select("route", "full_name", "name").distinct(), ["route", "full_name", "name"], "left_anti"))
    entries = direct.select(*_PROOF, "route", "full_name", "name", "method_id", "sure", "reason")
    if not rest.isEmpty():
        climb = parents.where("how = 'extends'").select(F.col("full_name").alias("id"), F.col("super").alias("parent"))
        # what is accepted depends on the kind of route, so the kind is part of the name that is looked for
        offers = F.explode(F.array(*(F.struct(F.lit(k).alias("source")) for k in ("struts", "struts2", "servlet", "spring"))))
        hits = by_owner.withColumn("k", offers).select("*", "k.source").where(accepted).select(F.col("full_name").alias("owner"), F.concat_ws("\1", "source", "name").alias("name"), F.struct("method_id", F.col("full_name").alias("owner"), "arity", "signature").alias("found"))
        up = traverse.nearest(climb, hits, rest.select(F.col("full_name").alias("id"), F.concat_ws("\1", "source", "name").alias("name")))
        inherited = cut(rest.join(up.select(F.col("id").alias("full_name"), F.split("name", "\1")[0].alias("source"), F.split("name", "\1")[1].alias("name"), "found"), ["full_name", "source", "name"]))
        entries = entries.unionByName(inherited.select(*_PROOF, "route", "full_name", "name", F.col("found.method_id").alias("method_id"), "sure", F.concat(F.lit("Inherited "), "reason").alias("reason")))
        # an inherited entry method may call a template method of the subclass
        template = F.coalesce(*(F.when(F.col("name") == k, F.lit(v)) for k, v in TEMPLATES.items()))
        templated = inherited.withColumn("template", template).where("template is not null")
        templated = templated.withColumn("look", F.concat_ws("/", "template", "found.arity"))
        contracts = by_owner.select(F.col("full_name").alias("t_owner"), F.concat_ws("/", "name", "arity").alias("look"), F.col("signature").alias("t_signature"))
        templated = cut(templated.join(contracts, (F.col("found.owner") == F.col("t_owner")) & (templated["look"] == contracts["look"])).drop(contracts["look"]))
        if not templated.isEmpty():
            handlers = traverse.nearest(climb, by_owner.where(F.col("name").isin(*TEMPLATES.values())).select(F.col("full_name").alias("owner"), F.concat_ws("/", "name", "arity").alias("name"), F.struct("method_id", F.col("full_name").alias("owner"), "signature").alias("found")), templated.select(F.col("full_name").alias("id"), F.col("look").alias("name")).distinct())
            handled = templated.join(handlers.select(F.col("id").alias("full_name"), F.col("name").alias("look"), F.col("found").alias("h")), ["full_name", "look"]).where("h.owner <> t_owner")
            handled = handled.where(tx.signature_simple(F.col("h.signature")) == tx.signature_simple(F.col("t_signature")))
            out.append(_emit(handled, _edge(_tag("route", "route"), "h.method_id", "dispatches_to", 0.9, "concat('Action template handler via inherited ', name)")))
    entries = cut(entries)
    out.append(_emit(entries, _edge(_tag("route", "route"), "method_id", "dispatches_to", "sure", "reason")))
    out.append(_emit(entered.join(entries.select("route", "full_name").distinct(), ["route", "full_name"], "left_anti"), _warning("unresolved-entry", "route", "full_name")))

    # outcomes and tiles
    tiles, puts = _kind(facts, "tile", "name", "extends", "template"), _kind(facts, "put", "tile", "name", "value")
    forwards = facts.where("kind = 'forward'").select(*_PROOF, *(F.coalesce(F.col("data")[f], F.lit("")).alias(n) for f, n in (("url", "url"), ("name", "name"), ("path", "to"))))
    known = tiles.select(F.col("name").alias("to"), F.lit("tile").alias("known")).union(routes.select("url", F.lit("route"))).groupBy("to").agg(F.max("known").alias("known"))
    shown = forwards.where("to <> ''").join(known, "to", "left").withColumn("page", F.when(F.col("to").startswith("/"), F.col("to")).otherwise(F.concat(F.lit("/"), "to")))
    outcome = "concat('outcome ', name)"
    ways = [_edge(_tag("route", "url"), _tag(kind, to), how, 1.0, outcome) for kind, to, how in (("tiles_definition", "to", "uses_tile"), ("route", "to", "redirects_to"), ("page", "page", "forwards_to"))]
    out.append(_emit(shown, f"case known when 'tile' then {ways[0]} when 'route' then {ways[1]} else {ways[2]} end", _if("known is null", _node("page", "page", file=False))))
    defined = tiles.select(F.col("name").alias("_parent")).distinct()
    composed = tiles.join(defined, F.col("extends") == F.col("_parent"), "left")
    own, page_of = _tag("tiles_definition", "name"), _tag("page", "template")
    out.append(
        _emit(
            composed,
            _node("tiles_definition", "name"),
            _if("extends <> ''", _if("_parent is null", _warning("unresolved-tile-parent", "name", "extends"), _edge(own, _tag("tiles_definition", "extends"), "extends_tile", 1.0, "'extends'"))),
            _if("template <> ''", _node("page", "template", file=False)),
            _if("template <> ''", _edge(own, page_of, "uses_template", 1.0, "'template'")),
        )
    )
    out.append(_emit(puts.where("value like '/%'"), _node("page", "value", file=False), _edge(_tag("tiles_definition", "tile"), _tag("page", "value"), "puts", 1.0, "name")))
    out.append(_emit(_kind(facts, "warning", "code").withColumn("at", F.concat_ws(":", "path", "line")), _record(what="2", id="code", name="at")))
    out.append(_emit(_kind(facts, "error", "type"), _warning("parser-error", "path")))

    records = cut(reduce(DataFrame.unionByName, out))
    nodes = records.where("what = 0").select("id", "type", "name", F.when(F.col("has_file"), F.col("path")).alias("file_path"), "evidence", F.col("search").alias("search_text"), "data", F.struct("path", "ord").alias("ord"))
    whole = cut(merge.merge_nodes(nodes))
    edges = records.where("what = 1").select(F.concat_ws("|", "source", "type", "target", "reason").alias("id"), "source", "target", "type", "confidence", "reason", "evidence", "path", "ord")
    kept = merge.first_wins(edges, ["id"], ["path", "ord"]).drop("path", "ord")
    for end in ("source", "target"):
        kept = kept.join(whole.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    kept = cut(kept.withColumn("ended", F.col("has_source").isNotNull() & F.col("has_target").isNotNull()).drop("has_source", "has_target"))
    lost = kept.where("not ended").select(F.lit("edge-without-end").alias("code"), F.col("id").alias("subject"))
    warnings = records.where("what = 2").select(F.col("id").alias("code"), F.col("name").alias("subject")).unionByName(lost).distinct()
    return Graph(whole, kept.where("ended").drop("ended"), warnings)


def confirmed_outcomes(graph: Graph, facts: DataFrame) -> DataFrame:
    """(edge, classification) of outcome edges: code-confirmed if the route maps to one type and one method that returns exactly this outcome name, which is unique on the route; else configured-candidate."""
    out = graph.edges.where("type in ('forwards_to', 'redirects_to', 'uses_tile')").select("id", F.col("source").alias("route"), F.regexp_replace("reason", "^outcome ", "").alias("name"))
    per = lambda t: graph.edges.where(F.col("type") == t).groupBy(F.col("source").alias("route")).agg(F.count_distinct("target").alias("n"), F.min("target").alias("only")).where("n = 1").select("route", F.col("only").alias(t))
    names = out.groupBy("route", "name").agg(F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    returned = _kind(facts, "java_return", "owner", "method", "arity", "name").select(F.concat(F.lit("java_method:"), "owner", F.lit("#"), "method", F.lit("/"), "arity").alias("base"), "name").distinct()
    sure = out.join(names, ["route", "name"]).join(per("maps_to"), "route").join(per("dispatches_to"), "route").join(returned, (F.split("dispatches_to", r"\(")[0] == F.col("base")) & (out["name"] == returned["name"])).select("id").distinct()
    return out.join(sure.withColumn("ok", F.lit(True)), "id", "left").select(F.col("id").alias("edge"), F.when(F.col("ok"), "code-confirmed").otherwise("configured-candidate").alias("classification"))


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): everything that makes a graph invalid; a valid graph gives no rows."""
    kinds = ("file", "page", "route", "java_type", "java_method", "spring_bean", "statement", "procedure", "tiles_definition", "table")
    links = ("contains", "submits_to", "links_to", "requests", "includes", "loads_script", "maps_to", "dispatches_to", "forwards_to", "redirects_to", "uses_tile", "declares", "implements", "implemented_by", "calls", "calls_procedure", "uses_statement", "reads_from", "writes_to", "extends", "extends_tile", "uses_template", "puts")
    tag = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("id"))
    bad = F.exists("evidence", lambda e: (e["line"] < 1) | (e["column"] < 1) | e["file"].startswith("/") | e["file"].contains(".."))
    parts = [
        tag(nodes.where(~F.col("type").isin(*kinds)), "node type"),
        tag(edges.where(~F.col("type").isin(*links)), "edge type"),
        tag(edges.where("confidence is null or confidence < 0 or confidence > 1"), "confidence"),
        tag(merge.repeated_ids(nodes), "node id repeats"),
        tag(merge.repeated_ids(edges), "edge id repeats"),
        tag(merge.orphan_edges(nodes, edges), "edge end is no node"),
        tag(nodes.where(bad), "node evidence"),
        tag(edges.where(bad), "edge evidence"),
        tag(nodes.where(~F.col("id").startswith(F.concat("type", F.lit(":")))), "node id prefix"),
    ]
    return reduce(DataFrame.unionByName, parts)
