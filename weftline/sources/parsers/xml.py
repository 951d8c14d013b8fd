"""XML dialects: SQL maps, deployment descriptors, action and tile configuration, bean wiring.

One scanner reads a file's markup as events with their offsets and tolerates what a strict reader
refuses; from the events come elements with their children, each of which knows where its content lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import sql
from .base import Facts, Source

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[?!][^>]*>|<(?P<shut>/?)(?P<tag>[A-Za-z_][\w:.-]*)(?P<inside>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?P<name>[\w:.-]+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)')")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    begin: int
    inside: int  # where the content begins
    end: int = -1  # where it ends; -1 while the element is open
    parts: list[Element | str] = field(default_factory=list)

    @property
    def closed(self) -> bool:
        return self.end >= 0

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    def all(self, *tags: str) -> Iterator[Element]:
        """Closed elements of these tags below, in order; none inside another of the same tag."""
        for p in self.parts:
            if isinstance(p, Element):
                if p.tag.lower() in tags and p.closed:
                    yield p
                    yield from (x for x in p.all(*tags) if x.tag.lower() != p.tag.lower())
                else:
                    yield from p.all(*tags)

    def text(self, mark: str = "") -> str:
        """Character data, with `mark` where elements begin and end."""
        return "".join(p if isinstance(p, str) else mark + p.text(mark) + mark for p in self.parts)

    def first(self, tag: str) -> str:
        return next((e.text().strip() for e in self.all(tag)), "")


def read(text: str) -> Element:
    """The file as one element. An end tag closes the nearest open element of its name and those inside that were left open; others are passed over."""
    root = Element("", {}, 0, 0)
    path, at = [root], 0
    for m in _MARK.finditer(text):
        if m.start() > at:
            path[-1].parts.append(text[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            path[-1].parts.append(m["cdata"])
        elif m["tag"] and not m["shut"]:
            inside = m["inside"]
            e = Element(m["tag"], {a["name"]: a["a"] if a["a"] is not None else a["b"] for a in _ATTRIBUTE.finditer(inside)}, m.start(), m.end())
            path[-1].parts.append(e)
            if inside.rstrip().endswith("/"):
                e.end = m.end()
            else:
                path.append(e)
        elif m["tag"] and (k := next((k for k in range(len(path) - 1, 0, -1) if path[k].tag.lower() == m["tag"].lower()), 0)):
            path[k].end = m.start()
            for lost in path[k + 1 :]:  # content of an element that was never closed belongs to its parent
                lost.end = -1
            del path[k:]
    path[-1].parts.append(text[at:])
    return root


def decoded(raw: str) -> str:
    """The SQL of an element's text: three entities are decoded."""
    for entity, char in (("lt", "<"), ("gt", ">"), ("amp", "&")):
        raw = re.sub(f"&{entity};", char, raw, flags=re.I)
    return raw


def _whole(e: Element, fragments: dict[str, Element], open_: tuple[str, ...] = ()) -> str:
    """An element's text with the fragments that it includes, each within itself once."""
    out = []
    for p in e.parts:
        if isinstance(p, str):
            out.append(p)
        elif p.tag.lower() == "include":
            name = p.get("refid")
            found = fragments.get(name) or fragments.get(name.rsplit(".", 1)[-1])
            out.append(_whole(found, fragments, (*open_, name)) if found is not None and name not in open_ else " ")
        else:
            out.append(" " + _whole(p, fragments, open_) + " ")
    return "".join(out)


def _sql_map(out: Facts, root: Element) -> None:
    space = root.get("namespace")
    full = lambda i: f"{space}.{i}" if space else i
    fragments: dict[str, Element] = {}
    for e in root.all("sql"):
        if name := e.get("id"):
            fragments |= {name: e, full(name): e}
    for e in sorted((e for kind in (*sql.KINDS, "procedure", "statement") for e in root.all(kind) if e.get("id")), key=lambda e: e.begin):
        kind, whole, name = e.tag.lower(), decoded(_whole(e, fragments)), e.get("id")
        text = " ".join(whole.split())
        reads, writes = sql.lineage(whole, kind)
        target = sql.called(whole)
        if kind == "procedure" and not target:
            out.warn("unresolved-procedure", e.begin, statement=full(name))
        includes = [i.get("refid") for i in e.all("include") if i.get("refid")]
        out.add("statement", e.begin, id=name, full_id=full(name), type=kind, sql=text, reads=reads, writes=writes, procedure=target, includes=includes, parameter_class=e.get("parameterClass") or e.get("parameterMap"), result_class=e.get("resultClass"), result_map=e.get("resultMap"))


def _web(out: Facts, root: Element) -> None:
    classes = {e.first("servlet-name"): e.first("servlet-class") for e in root.all("servlet") if e.first("servlet-class")}
    for e in root.all("servlet-mapping"):
        name, url = e.first("servlet-name"), e.first("url-pattern")
        if name and url:
            out.add("route", e.begin, url=url, target=classes.get(name, ""), source="servlet", servlet=name)


def _struts(out: Facts, root: Element) -> None:
    for e in root.all("action"):
        path = e.get("path")
        if path and e.get("type"):
            named = path.rsplit(".", 1)[-1] if "." in path else ""
            url = path if named.isascii() and named.isalnum() else path + ".do"
            out.add("route", e.begin, url=url, target=e.get("type"), source="struts", parameter=e.get("parameter"), form=e.get("name"))
            for f in e.all("forward"):
                out.add("forward", f.begin, url=url, name=f.get("name"), path=f.get("path"))


def action_url(namespace: str, name: str, extension: str) -> str:
    """The URL of an action: its namespace, its name, and the extension unless the name has it."""
    parts = [p for p in f"{namespace}/{name}".split("/") if p]
    url = "/" + "/".join(parts) + ("/" if name.endswith("/") else "")
    return url if url.lower().endswith(extension.lower()) else url + extension


def _struts2(out: Facts, root: Element) -> None:
    chosen = [e.get("value") or e.text().strip() for e in root.all("constant") if e.get("name").lower() == "struts.action.extension"]
    ending = chosen[-1].split(",")[0].strip().removeprefix(".") if chosen else "action"
    extension = f".{ending}" if ending else ""
    for package in root.all("package"):
        space = package.get("namespace")
        for a in package.all("action"):
            if not (a.get("name") and a.get("class")):
                continue
            url = action_url(space, a.get("name"), extension)
            out.add("route", a.begin, url=url, target=a.get("class"), source="struts2", method=a.attributes.get("method", "execute"), explicit="method" in a.attributes)
            for r in a.all("result"):
                given = {x.get("name"): x.text().strip() for x in r.all("param")}
                own = "".join(p for p in r.parts if isinstance(p, str)).strip()
                to = given.get("actionName") or own
                if r.get("type").lower().startswith("redirectaction"):
                    to = action_url(given.get("namespace") or space, to, extension)
                out.add("forward", r.begin, url=url, name=r.attributes.get("name", "success"), path=to, type=r.get("type"))


def _tiles(out: Facts, root: Element) -> None:
    for e in root.all("definition"):
        if name := e.get("name"):
            out.add("tile", e.begin, name=name, extends=e.get("extends"), template=e.get("template"))
            for p in e.all("put", "put-attribute"):
                if p.get("name") and (value := p.get("value") or p.text().strip()):
                    out.add("put", p.begin, tile=name, name=p.get("name"), value=value)


def _spring(out: Facts, root: Element) -> None:
    beans, classes = list(root.all("bean")), {}
    for e in beans:
        name = e.get("id") or e.get("name")
        if name and e.get("class"):
            classes[name] = e.get("class")
            out.add("bean", e.begin, id=name, target=e.get("class"))
    for e in beans:
        if e.get("class").rsplit(".", 1)[-1] != "SimpleUrlHandlerMapping":
            continue
        for p in e.all("property"):
            for x in p.all("prop", "entry") if p.get("name") == "mappings" else ():
                if x.tag.lower() == "prop":
                    url, bean = x.get("key").strip(), x.text().strip()
                else:
                    url, bean = x.get("key") or x.get("key-ref"), x.get("value-ref") or x.get("value")
                if url.startswith("/") and bean:
                    out.add("route", x.begin, url=url, target=classes.get(bean, ""), source="spring", bean=bean)


_DIALECTS = {"sqlmap": _sql_map, "web-app": _web, "struts-config": _struts, "struts": _struts2, "tiles-definitions": _tiles, "beans": _spring}


def _roots(e: Element) -> Iterator[Element]:
    """Elements that begin a dialect, open ones too; none inside another."""
    for p in e.parts:
        if isinstance(p, Element):
            if p.tag.lower() in _DIALECTS:
                yield p
            else:
                yield from _roots(p)


def parse(text: str) -> Facts:
    """Facts of every dialect whose root a file has, and warnings of open roots, comments and CDATA."""
    out, seen = Facts(Source(text)), set()
    for e in _roots(read(text)):
        if (tag := e.tag.lower()) not in seen:
            seen.add(tag)
            _DIALECTS[tag](out, e)
            if not e.closed:
                out.warn("unclosed-root", 0, tag=e.tag)
    for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        if (last := text.rfind(begin)) > text.rfind(end):
            out.warn("unclosed-section", last, tag=begin)
    return out
