"""Pages and scripts: requests of forms, links, tags and scripts, fields with their forms, includes, visible text."""

from __future__ import annotations

import re

from .base import Facts, Source, blank

# Fixed values.
METHODS = {"GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"}
_FORMS = {"form": "GET", "html:form": "POST", "s:form": "POST", "form:form": "POST"}
_LINKS = {"a": "href", "html:link": "href", "html:rewrite": "href", "s:url": "value", "s:a": "href"}
_FIELDS = {"input", "select", "textarea", "button"} | {f"{p}:{t}" for p, ts in {"html": ("text", "hidden", "password", "checkbox", "radio", "select", "textarea", "submit"), "s": ("textfield", "hidden", "password", "checkbox", "select", "textarea", "submit"), "form": ("input", "hidden", "password")}.items() for t in ts}
_HIDDEN = re.compile(r"<%--.*?(?:--%>|\Z)|<!--.*?(?:-->|\Z)|<%(?![@=]).*?(?:%>|\Z)|<template\b.*?</template\s*>", re.S | re.I)
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_STYLE = re.compile(r"<style\b.*?</style\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\s+(?:[\w:.@-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|<[^>]*>))*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.@-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_JS = re.compile(
    r"(?P<skip>\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z)|<!--[^\r\n]*)|(?P<string>\"(?:\\.|[^\"\\\r\n])*\"?|'(?:\\.|[^'\\\r\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<op>\.\.\.|=>|.)",
    re.S,
)
_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_JS_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "throw", "else", "do"}
# Entities that are decoded by name.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}
_CONTEXT = re.compile(r"^(?:\$\{pageContext\.request\.contextPath\}|<%=\s*request\.getContextPath\(\)\s*%>)")
_DYNAMIC = re.compile(r"\$\{|#\{|<%|%\{")


def decoded(text: str) -> str:
    """Five named entities and numeric ones; a number that is no character becomes U+FFFD, other names stay."""

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3].lower(), m[0])
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"

    return re.sub(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z]+));", one, text)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): decoded(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTRIBUTE.finditer(text)}


def method_of(text: str, default: str) -> str:
    up = text.strip().upper()
    return default if not up else up if up in METHODS else ""


def target_of(text: str) -> str:
    """A request's URL without the context path, or '' if it is external or dynamic."""
    url = _CONTEXT.sub("", decoded(text).strip())
    url = m[1] if (m := re.match(r"<c:url\s+value\s*=\s*['\"]([^'\"]*)['\"]\s*/?>", url)) else url
    if not url or url.startswith(("#", "//", "javascript:", "mailto:")) or re.match(r"[a-z][a-z0-9+.-]*:", url, re.I) or _DYNAMIC.search(url.split("?")[0]):
        return ""
    return url.split("#")[0]


def js_tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, begin) of a script, without comments; strings and regular expressions are single tokens."""
    out, at = [], 0
    while at < len(text):
        m = _JS.match(text, at)
        kind, got = m.lastgroup, m[0]
        before = out[-1] if out else ("op", "(", 0)
        if got == "/" and (before[0] == "op" and before[1] not in ")]}" or before[1] in _JS_BEFORE) and (r := _JS_REGEX.match(text, at)):
            kind, got = "regex", r[0]
        if kind != "skip":
            out.append((kind, got, at))
        at += len(got)
    return out


def _properties(toks: list[tuple[str, str, int]], i: int) -> tuple[dict[str, str | None], int]:
    """Properties of the object literal at i: plain strings, None for other values; the last of a name counts, and a spread makes all before it unknown. Also the token after the object."""
    found: dict[str, str | None] = {}
    level, name = 0, ""
    for k in range(i, len(toks)):
        kind, text, _ = toks[k]
        if kind == "op" and text in "([{":
            level += 1
        elif kind == "op" and text in ")]}":
            level -= 1
            if not level:
                return found, k + 1
        if level == 1:
            if text == "..." and kind == "op":
                found = {**dict.fromkeys(found), "...": None}
            elif kind == "op" and text == ":" and toks[k - 1][0] in ("word", "string") and toks[k - 2][1] in "{,":
                name = toks[k - 1][1].strip("\"'")
                value, after = toks[k + 1 : k + 2], toks[k + 2 : k + 3]
                plain = value and value[0][0] == "string" and after and after[0][1] in ",}"
                found[name] = value[0][1][1:-1] if plain else None
    return found, len(toks)


def script(out: Facts, text: str, base: int = 0) -> None:
    """fetch, XMLHttpRequest.open and $.ajax calls whose URL is a plain string; comments, strings and regular expressions hold none."""
    toks = js_tokens(text)
    word = lambda i: toks[i][1] if 0 <= i < len(toks) and toks[i][0] in ("word", "op") else ""
    string = lambda i: toks[i][1][1:-1] if 0 <= i < len(toks) and toks[i][0] == "string" else None
    for i, (kind, name, at) in enumerate(toks):
        if kind != "word" or word(i + 1) != "(":
            continue
        url = string(i + 2)
        if name == "fetch" and url is not None and word(i - 1) != "function" and word(i + 3) in (",", ")"):
            given = _properties(toks, i + 4)[0] if word(i + 3) == "," and word(i + 4) == "{" else {}
            unknown = "method" in given and given["method"] is None or "..." in given and given.get("method") is None
            _request(out, base + at, "fetch", url, "" if unknown else method_of(given.get("method") or "", "GET"))
        elif name == "open" and word(i - 1) == "." and url is not None and word(i + 3) == "," and (target := string(i + 4)) is not None and word(i + 5) in (",", ")"):
            _request(out, base + toks[i - 1][2], "xhr", target, method_of(url, "GET"))
        elif name == "ajax" and word(i - 1) == "." and word(i - 2) in ("$", "jQuery") and word(i + 2) == "{":
            given, _ = _properties(toks, i + 2)
            verb = next((given[k] for k in reversed(given) if k in ("type", "method")), None if "..." in given else "")
            if given.get("url"):
                _request(out, base + toks[i - 2][2], "ajax", given["url"], "" if verb is None else method_of(verb, "GET"))


def _request(out: Facts, at: int, kind: str, url: str, verb: str) -> None:
    if target := target_of(url):
        path, _, query = target.partition("?")
        names = [p.split("=")[0] for p in query.split("&") if p and not _DYNAMIC.search(p.split("=")[0])]
        values = dict(p.partition("=")[::2] for p in query.split("&") if p)
        out.add("request", at, kind=kind, url=path, method=verb, names=names, query="&".join(f"{n}={'' if _DYNAMIC.search(v) else v}" for n, v in values.items()))


def parse_script(text: str) -> Facts:
    out = Facts(Source(text))
    script(out, text)
    return out


def parse(text: str) -> Facts:
    """Facts of a page; comments, scriptlets and templates are blanked, scripts scanned by themselves."""
    out, shown = Facts(Source(text)), blank(text, _HIDDEN)
    for m in re.finditer(r"<%@\s*include\s+file\s*=\s*[\"']([^\"']+)[\"']", shown):
        out.add("include", m.start(), path=m[1])
    for m in _SCRIPT.finditer(shown):
        a = attributes(m[1])
        if a.get("src") and (target := target_of(a["src"])):
            out.add("script", m.start(), path=target)
        if a.get("type", "text/javascript").lower() in ("", "text/javascript", "application/javascript", "module"):
            script(out, m[2], m.start(2))
    shown = _SCRIPT.sub(lambda m: m[0].replace(m[2], re.sub(r"[^\n]", " ", m[2])) if m[2] else m[0], blank(shown, _STYLE))
    tags = [(m, m[2].lower(), attributes(m[3])) for m in _TAG.finditer(shown)]
    forms: list[tuple[int, int, dict]] = []
    open_: list[tuple[int, dict]] = []
    for m, name, a in tags:
        if name in _FORMS:
            if not m[1]:
                url = target_of(a.get("action", ""))
                f = {"form": str(len(forms) + len(open_)), "id": a.get("id", ""), "url": url.partition("?")[0], "method": method_of(a.get("method", ""), _FORMS[name])}
                open_.append((m.start(), f))
                if url:
                    _request(out, m.start(), "form", url, f["method"])
            elif open_:
                begin, f = open_.pop()
                forms.append((begin, m.start(), f))
    forms += [(begin, len(text), f) for begin, f in open_]
    ids = [f["id"] for _, _, f in forms if f["id"]]
    for m, name, a in tags:
        if m[1]:
            continue
        if name in _LINKS and a.get(_LINKS[name]):
            _request(out, m.start(), "link", a[_LINKS[name]], "GET")
        elif name == "jsp:include" and a.get("page"):
            out.add("include", m.start(), path=a["page"])
        elif name in _FIELDS:
            field = a.get("name") or a.get("property") or a.get("path", "")
            if not field:
                continue
            if _DYNAMIC.search(field):
                out.warn("dynamic-field", m.start())
                continue
            inside = min((x for x in forms if x[0] < m.start() < x[1]), key=lambda x: x[1] - x[0], default=None)
            if a.get("form") and ids.count(a["form"]) == 1:
                inside = next(x for x in forms if x[2]["id"] == a["form"])
            kind = a.get("type", "").lower() or name.split(":")[-1]
            value = a.get("value", "")
            out.add("field", m.start(), name=field, type=kind, default="" if _DYNAMIC.search(value) else value, runtime=bool(_DYNAMIC.search(value)), disabled="disabled" in a, form=inside[2]["form"] if inside else "", url=inside[2]["url"] if inside else "")
    plain = re.sub(r"<%.*?%>|<[^>]+>", "\n", re.sub(r"\$\{[^}]*\}", " ", shown), flags=re.S)
    words = [w for w in (decoded(re.sub(r"\s+", " ", x)).strip() for x in plain.split("\n")) if any(c.isalnum() for c in w)]
    if words:
        out.add("text", 0, text=list(dict.fromkeys(words)))
    return out
