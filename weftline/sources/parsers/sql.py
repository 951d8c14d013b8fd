"""SQL: tables that statements read and write, procedure calls, stored procedures of scripts.

A text becomes tokens without comments and string contents; names are read after the keywords that
introduce them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from .base import Facts, Source

# Words that cannot be the alias of a table.
NO_ALIAS = ("where", "join", "inner", "left", "right", "full", "cross", "on", "group", "order", "set", "union", "having", "option")
KINDS = ("select", "update", "insert", "delete")
_TOKEN = re.compile(r"(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*(?:'|\Z))|(?P<name>\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_$#]*)|(?P<op>.)", re.S)


def table_name(text: str) -> str:
    """Normal form of an identifier: no quotes or brackets, dots without spaces, lower case."""
    return ".".join(part.strip() for part in re.sub(r"[\[\]`\"']", "", text).split(".")).strip().lower()


class Token(NamedTuple):
    kind: str
    text: str  # keywords in upper case are compared with up
    begin: int
    end: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "name" and self.text[0] != "[" else ""


class Tokens:
    """Tokens with what the readers of statements ask of them."""

    def __init__(self, sql: str):
        self.sql = sql
        self.toks = [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(sql) if m.lastgroup != "skip"]

    def __len__(self) -> int:
        return len(self.toks)

    def up(self, i: int) -> str:
        """The keyword at i, if it is one: a word, not in brackets, and not a parameter's name."""
        return self.toks[i].up if 0 <= i < len(self.toks) and not self.op(i - 1, "@") else ""

    def op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "op" and self.toks[i].text == text

    def name(self, i: int) -> tuple[str, int]:
        """The dotted name at i in its normal form and the token after it; '' if there is none."""
        if not (i < len(self.toks) and self.toks[i].kind == "name"):
            return "", i
        k = i + 1
        while self.op(k, ".") and k + 1 < len(self.toks) and self.toks[k + 1].kind == "name":
            k += 2
        return ".".join(table_name(t.text) for t in self.toks[i:k:2]), k


@dataclass
class Tables:
    """What a statement names, by how it names it."""

    read: list[str] = field(default_factory=list)
    using: list[str] = field(default_factory=list)
    written: dict[str, list[str]] = field(default_factory=lambda: {k: [] for k in KINDS})
    alias: dict[str, str] = field(default_factory=dict)
    ctes: set[str] = field(default_factory=set)


def tables(t: Tokens, begin: int = 0, end: int | None = None) -> Tables:
    """Walk over a statement's tokens: each keyword says what the name after it is."""
    out = Tables()
    for i in range(begin, len(t) if end is None else end):
        word, after = t.up(i), t.up(i + 1)
        if word in ("FROM", "JOIN"):
            table, k = t.name(i + 1)
            if table:
                out.read.append(table)
                k += t.up(k) == "AS"
                alias = t.up(k).lower()
                if alias and alias not in NO_ALIAS:
                    out.alias[alias] = table
        elif word == "USING":
            out.using.append(t.name(i + 1)[0])
        elif word == "UPDATE" and after != "SET":
            out.written["update"].append(t.name(i + 1)[0])
        elif word == "INTO" and t.up(i - 1) == "MERGE":
            out.written["update"].append(t.name(i + 1)[0])
        elif word == "INTO" and t.up(i - 1) == "INSERT":
            out.written["insert"].append(t.name(i + 1)[0])
        elif word == "DELETE":
            table, k = t.name(i + 2 if after == "FROM" else i + 1)
            if after == "FROM" or t.up(k) == "FROM":
                out.written["delete"].append(table)
        elif word == "AS" and t.op(i + 1, "("):  # a common table expression: WITH name AS ( or , name AS (
            k = i - 1
            while k > 1 and t.op(k - 1, "."):
                k -= 2
            if t.up(k - 1) == "WITH" or t.op(k - 1, ","):
                out.ctes.add(t.name(k)[0])
    return out


def resolved(found: Tables, kind: str) -> tuple[list[str], list[str]]:
    """Sorted tables that a statement of a kind reads and writes; kind `statement` may write in any way."""
    kinds = KINDS if kind == "statement" else (kind,)
    writes = {found.alias.get(x, x) for k in kinds for x in found.written.get(k, ()) if x}
    reads = {x for x in found.read + (found.using if "update" in kinds else []) if x}
    return sorted(reads - writes - found.ctes), sorted(writes)


def lineage(sql: str, kind: str) -> tuple[list[str], list[str]]:
    return resolved(tables(Tokens(sql)), kind)


def called(sql: str) -> str:
    """The first procedure that a statement calls, or ''."""
    t = Tokens(sql)
    return next((name for i in range(len(t)) if t.up(i) in ("CALL", "EXEC", "EXECUTE") and (name := t.name(i + 1)[0])), "")


def _definition(t: Tokens, i: int) -> int:
    """Where the name stands in the procedure definition that begins at i; 0 if none does."""
    k = i + 1
    if t.up(i) == "CREATE" and t.up(k) == "OR" and t.up(k + 1) == "ALTER":
        k += 2
    elif t.up(i) not in ("CREATE", "ALTER"):
        return 0
    return k + 1 if t.up(k) in ("PROC", "PROCEDURE") and t.name(k + 1)[0] else 0


def _batch_end(t: Tokens, i: int) -> bool:
    """Whether token i is a GO that has its line to itself."""
    tok = t.toks[i]
    return tok.up == "GO" and not t.sql[t.sql.rfind("\n", 0, tok.begin) + 1 : tok.begin].strip() and not t.sql[tok.end : (t.sql + "\n").index("\n", tok.end)].strip()


def _calls(t: Tokens, begin: int, end: int) -> tuple[set[str], int | None]:
    """Procedures that a body runs by name, and the first place where it runs what a variable or text holds."""
    found, dynamic = set(), None
    for i in range(begin, end):
        if t.up(i) not in ("EXEC", "EXECUTE"):
            continue
        k = i + 1
        if t.op(k, "@") and t.op(k + 2, "="):  # the result goes to a variable
            k += 3
        if t.op(k, "(") or t.op(k, "@"):
            dynamic = i if dynamic is None else dynamic
        elif t.up(k) != "AS" and (name := t.name(k)[0]):
            found.add(name)
    return found, dynamic


def parse(text: str) -> Facts:
    """Procedures of a SQL Server script: a definition ends at a GO line or the next definition."""
    out, t = Facts(Source(text)), Tokens(text)
    heads = [(i, at) for i in range(len(t)) if (at := _definition(t, i)) and not (t.up(i) == "ALTER" and t.up(i - 1) == "OR")]
    for n, (i, at) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(t)
        name, k = t.name(at)
        end = next((j for j in range(k, end) if _batch_end(t, j)), end)
        as_ = next((j for j in range(k, end) if t.up(j) == "AS"), None)
        body = k if as_ is None else as_ + 1
        found = tables(t, body, end)
        both = [resolved(found, kind) for kind in KINDS]
        writes = {x for _, w in both for x in w}
        calls, dynamic = _calls(t, body, end)
        if dynamic is not None:
            out.warn("dynamic-procedure", t.toks[dynamic].begin)
        head = text[t.toks[k - 1].end : t.toks[as_].begin] if as_ is not None else ""
        params = [p for p in (" ".join(p.split()) for p in head.split(",")) if p.startswith("@")]
        out.add("procedure", t.toks[i].begin, full_name=name, name=name.rsplit(".", 1)[-1], parameters=params, reads=sorted({x for r, _ in both for x in r} - writes), writes=sorted(writes), calls=sorted(calls))
    return out
