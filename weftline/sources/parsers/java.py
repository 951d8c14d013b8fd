"""Java: types, fields, methods, calls, local variables, constants, statement uses and returned results.

The text becomes tokens, without comments and with strings as single tokens. One walk over them keeps
the open scopes: types, methods, hidden bodies (lambdas and anonymous classes) and plain blocks.
Declarations are read where a statement begins, uses where the nearest scope is a method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from .base import Facts, Source

# The calls that run mapped statements, what marks their receivers and the constants that may name
# one, how sure each way of naming is, what a method of each result type returns.
VERBS = ("queryForObject", "queryForList", "queryForMap", "insert", "update", "delete")
MAPPER, NAMING = ("sqlmap", "sqlsession"), ("statement", "query", "sql", "mapper", "id")
SURE = {"literal": 1.0, "class-constant": 0.95, "class-constant-candidate": 0.7}
RESULTS = {"ActionForward": "find-forward", "String": "string-literal"}

_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_VISIBLE = ("public", "protected", "private")
_KINDS = {"class", "interface", "enum"}
_WORDS = {"return", "new", "throw", "else", "case", "package", "import", "if", "while", "for", "switch", "do", "try", "catch", "assert", "break", "continue", "goto", "instanceof", "yield", "default", "finally", *_KINDS}
_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<block>"""(?:\\.|.)*?(?:"""|\Z))|(?P<string>"(?:\\.|[^"\\\r\n])*"?)'
    r"|(?P<char>'(?:\\.|[^'\\\r\n])*'?)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<op>->|::|\.\.\.|.)",
    re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    begin: int


_NONE = Token("end", "", -1)


@dataclass
class Scope:
    kind: str  # type, method, hidden or block
    facts: dict = field(default_factory=dict)
    resume: int | None = None  # where the statement began that goes on after this body
    parens: int = 0  # open round and square brackets outside


def translate(text: str) -> tuple[str, list[int] | None]:
    """Unicode escapes become their characters. Also the raw offset of each character, None if nothing changed.

    A backslash begins an escape after an even number of raw ones; those that an escape makes don't count.
    """
    out, places, at = [], [], 0
    for m in re.finditer(r"\\(?:u+([0-9A-Fa-f]{4})|.)", text, re.S):
        if m[1]:
            out += [text[at : m.start()], chr(int(m[1], 16))]
            places += [*range(at, m.start()), m.start()]
            at = m.end()
    return ("".join([*out, text[at:]]), [*places, *range(at, len(text) + 1)]) if out else (text, None)


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]


def unescape(text: str) -> str:
    return translate(text)[0]


def joined(part: list[Token]) -> str:
    """Tokens as source, with spaces between words only."""
    out = ""
    for t in part:
        out += " " + t.text if out and t.kind == "word" and (out[-1].isalnum() or out[-1] in "_$?") else t.text
    return out


class Parser:
    def __init__(self, raw: str):
        text, self.places = translate(raw)
        self.text, self.toks = text, tokens(text)
        self.out = Facts(Source(raw, cr=True))
        self.rows: dict[str, list[tuple[int, dict]]] = {k: [] for k in ("import", "java_type", "java_field", "java_method", "java_return", "java_local", "java_call", "java_constant", "statement_use")}
        self.package = ""
        self.opens: dict[int, Scope] = {}  # scopes by the token that opens them
        self.hidden_to = -1  # tokens before this one belong to the expression of a lambda
        self.stack: list[Scope] = []

    # --- tokens

    def tok(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else _NONE

    def is_(self, i: int, *texts: str) -> bool:
        t = self.tok(i)
        return t.kind in ("word", "op") and t.text in texts

    def word(self, i: int) -> bool:
        return self.tok(i).kind == "word"

    def raw(self, i: int) -> int:
        at = self.tok(i).begin
        return at if self.places is None else self.places[at]

    def line(self, i: int) -> int:
        """Begin of the line of a token."""
        return self.out.source.line_begin(self.raw(i))

    def closing(self, i: int) -> int:
        """The token that closes the bracket at i, or the end."""
        level = 0
        for k in range(i, len(self.toks)):
            if self.is_(k, *_PAIRS):
                level += 1
            elif self.is_(k, *_PAIRS.values()):
                level -= 1
                if not level:
                    return k
        return len(self.toks)

    def angle(self, i: int) -> int:
        """After the type arguments that begin at i; i itself if there are none."""
        if not self.is_(i, "<"):
            return i
        level, k = 0, i
        while k < len(self.toks):
            if self.is_(k, "<"):
                level += 1
            elif self.is_(k, ">"):
                level -= 1
                if not level:
                    return k + 1
            elif not (self.word(k) or self.is_(k, ",", ".", "?", "[", "]", "&", "@")):
                return i
            k += 1
        return i

    def dotted(self, i: int) -> int:
        """After the dotted name at i."""
        k = i + 1
        while self.is_(k, ".") and self.word(k + 1):
            k += 2
        return k

    def type_end(self, i: int) -> int:
        """After the type at i; i itself if there is none."""
        if not self.word(i) or self.tok(i).text in _WORDS:
            return i
        k = self.angle(self.dotted(i))
        while self.is_(k, ".") and self.word(k + 1):  # a member of a type with arguments
            k = self.angle(k + 2)
        while self.is_(k, "[") and self.is_(k + 1, "]"):
            k += 2
        return k

    def annotations(self, i: int) -> int:
        while self.is_(i, "@") and self.word(i + 1) and not self.is_(i + 1, "interface"):
            i = self.dotted(i + 1)
            if self.is_(i, "("):
                i = self.closing(i) + 1
        return i

    def names(self, i: int) -> tuple[list[str], int]:
        """Types of a comma list without their arguments, and the token after it."""
        found = []
        while (k := self.type_end(self.annotations(i))) > (i := self.annotations(i)):
            found.append(joined(self.toks[i : self.dotted(i)]))
            if not self.is_(k, ","):
                return found, k
            i = k + 1
        return found, i

    # --- declarations

    def owner(self) -> Scope | None:
        """The nearest type around."""
        return next((s for s in reversed(self.stack) if s.kind == "type"), None)

    def method(self) -> dict | None:
        """The method whose own code this is."""
        for s in reversed(self.stack):
            if s.kind != "block":
                return s.facts if s.kind == "method" else None
        return None

    def type_(self, i: int, begin: int) -> None:
        """A declaration whose keyword is at i, in a statement that begins at `begin`."""
        kind, name = self.tok(i).text, self.tok(i + 1).text
        k, lists = self.angle(i + 2), {"extends": [], "implements": [], "permits": []}
        while self.tok(k).text in lists and self.word(k):
            lists[self.tok(k).text], k = self.names(k + 1)
        if not self.is_(k, "{"):
            return
        parent = self.owner()
        member = bool(self.stack) and self.stack[-1].kind == "type"
        plain = f"{self.package}.{name}" if self.package else name
        p = parent.facts if parent else {}
        if not self.stack:
            full, canonical = plain, plain
        elif member:
            full, canonical = f"{p['full_name']}${name}", f"{p['canonical']}.{name}" if p["canonical"] else ""
        else:
            full, canonical = f"{p['full_name']}$local${name}${self.raw(i)}" if parent else f"{plain}$nested${self.raw(i)}", ""
        static = member and (p["kind"] == "interface" or kind != "class" or any(self.is_(j, "static") for j in range(begin, i)))
        # further parents of an interface count as its interfaces
        facts = {"kind": kind, "name": name, "full_name": full, "canonical": canonical, "package": self.package, "top_level": not self.stack, "static_member": static}
        facts |= {"extends": (lists["extends"] or [""])[0], "implements": lists["extends"][1:] + lists["implements"]}
        self.rows["java_type"].append((self.raw(i), facts))
        self.opens[k] = Scope("type", facts)

    def parameters(self, i: int, end: int) -> tuple[list[str], list[str]]:
        """Names and types of the parameters between two tokens."""
        names, types, k = [], [], i
        while k < end:
            at, level = k, 0
            while k < end and not (self.is_(k, ",") and not level):
                level += self.is_(k, "<", "(", "[", "{") - self.is_(k, ">", ")", "]", "}")
                k += 1
            at = self.annotations(at)
            part = [t for j, t in enumerate(self.toks[at:k], at) if not self.is_(j, "final")]
            tail = []
            while len(part) > 1 and part[-1].text == "]" and part[-2].text == "[":
                part, tail = part[:-2], [*part[-2:], *tail]
            if len(part) > 1 and part[-1].kind == "word":
                names.append(part[-1].text)
                types.append(joined([*part[:-1], *tail]))
            k += 1
        return names, types

    def member(self, i: int) -> None:
        """A field, constant or method that begins at i in a type's body."""
        own, i = self.stack[-1].facts["full_name"], self.annotations(i)
        k, mods = i, []
        while self.word(k) and self.tok(k).text in _MODIFIERS or self.is_(k, "@") and not self.is_(k + 1, "interface"):
            if self.is_(k, "@"):
                k = self.annotations(k)
            else:
                mods.append(self.tok(k).text)
                k += 1
        k = self.angle(k)
        end = self.type_end(k)
        if end == k:
            return
        if self.is_(end, "(") and end == k + 1:  # a constructor counts as a method whose result is its last modifier
            name, result = k, mods[-1] if mods else ""
        else:
            name, result = end, joined(self.toks[k:end])
        if not result or not self.word(name) or self.tok(name).text in _WORDS:
            return
        shown = next((m for m in mods if m in _VISIBLE), "")
        if self.is_(name + 1, "("):
            shut = self.closing(name + 1)
            names, types = self.parameters(name + 2, shut)
            after = shut + 1
            while after < len(self.toks) and not self.is_(after, "{", ";", "}"):
                after += 1
            facts = {"owner": own, "name": self.tok(name).text, "visibility": shown or "package", "return_type": result, "parameters": names, "types": types, "arity": len(names), "signature": ",".join(types)}
            self.rows["java_method"].append((self.line(i), facts))
            if self.is_(after, "{"):
                self.opens[after] = Scope("method", facts)
        elif self.is_(name + 1, "=", ";", ","):
            if shown:
                self.rows["java_field"].append((self.line(i), {"owner": own, "name": self.tok(name).text, "type": result}))
            value = self.tok(name + 2)
            if result == "String" and self.is_(name + 1, "=") and value.kind == "string" and len(value.text) > 2 and self.is_(name + 3, ";"):
                self.rows["java_constant"].append((self.raw(i), {"owner": own, "name": self.tok(name).text, "value": value.text[1:-1]}))

    # --- uses

    def add(self, kind: str, i: int, /, **data) -> None:
        m = self.method()
        self.rows[kind].append((self.raw(i), {"owner": m["owner"], "method": m["name"], "arity": m["arity"], "signature": m["signature"]} | data))

    def returned(self, i: int) -> None:
        """`return x.findForward("n");` or `return "n";`, as the method's result type has it."""
        result = re.sub(r"<.*>", "", self.method()["return_type"]).rsplit(".", 1)[-1]
        at = i + 1
        if result == "ActionForward" and self.word(at):
            at = self.dotted(at)
            if not (at > i + 2 and self.is_(at - 1, "findForward") and self.is_(at, "(") and self.is_(at + 2, ")") and self.is_(at + 3, ";")):
                return
            at += 1
        elif not (result == "String" and self.is_(at + 1, ";")):
            return
        t = self.tok(at)
        if t.kind == "string" and "\\" not in t.text and len(t.text) > 1:
            self.add("java_return", i, name=t.text[1:-1], kind=RESULTS[result])

    def local(self, i: int) -> None:
        end = self.type_end(i)
        if end > i and self.word(end) and self.tok(end).text not in _WORDS and self.is_(end + 1, "=", ";", ","):
            self.add("java_local", i - self.is_(i - 1, "final", "volatile"), name=self.tok(end).text, type=joined(self.toks[i:end]))

    def call(self, i: int) -> None:
        """`receiver.method(` and, on a method of this object, `getter().method(`."""
        end = self.dotted(i)
        parts = [self.tok(k).text for k in range(i, end, 2)]
        if not self.is_(end, "("):
            return
        if len(parts) > 1 and not self.is_(i - 1, "new"):
            self.add("java_call", i, receiver=".".join(parts[:-1]), called=parts[-1])
        if (len(parts) == 1 or len(parts) == 2 and parts[0] == "this") and not self.is_(i - 1, ".") and self.is_(end + 1, ")") and self.is_(end + 2, ".") and self.word(end + 3) and self.is_(end + 4, "("):
            self.add("java_call", i, receiver=parts[-1], receiver_method=parts[-1], called=self.tok(end + 3).text)

    def statement(self, i: int) -> None:
        """A verb with a literal or a name as its statement, on a receiver that maps statements. Constants and fields are looked up at the end."""
        named = self.tok(i + 2)
        receiver = i - 2 if self.is_(i - 1, ".") else -1
        if self.is_(receiver, ")") and self.is_(receiver - 1, "("):
            receiver -= 2
        if named.kind in ("string", "word") and len(named.text) > (2 if named.kind == "string" else 0) and self.word(receiver):
            self.add("statement_use", i, operation=self.tok(i).text, receiver=self.tok(receiver).text, named=named)

    # --- the walk

    def arrow(self, i: int, start: int, parens: int) -> int:
        """A `->`: the statement after a switch rule's begins anew; a lambda's body is hidden. Returns where the statement begins."""
        if not parens and self.is_(start, "case", "default"):
            return i + 1
        if self.is_(i + 1, "{"):
            self.opens[i + 1] = Scope("hidden")
        elif i >= self.hidden_to:
            k, level = i + 1, 0
            while k < len(self.toks):
                if self.is_(k, "<") and (self.is_(k - 1, ".") or self.after_new(k)):
                    k = max(k, self.angle(k) - 1)
                elif self.is_(k, *_PAIRS):
                    level += 1
                elif not level and self.is_(k, ",", ";", *_PAIRS.values()):
                    break
                elif self.is_(k, *_PAIRS.values()):
                    level -= 1
                k += 1
            self.hidden_to = k
        return start

    def after_new(self, i: int) -> bool:
        """Whether the name before i follows `new`."""
        k = i - 1
        while self.word(k) and self.is_(k - 1, "."):
            k -= 2
        return self.word(k) and self.is_(k - 1, "new")

    def anonymous(self, i: int) -> None:
        """A `new` with a body."""
        k = self.angle(self.annotations(i + 1))
        k = self.type_end(self.annotations(k))
        if self.is_(k, "("):
            k = self.closing(k) + 1
            if self.is_(k, "{"):
                self.opens[k] = Scope("hidden")

    def walk(self) -> None:
        start, parens = 0, 0  # the statement's first token, and brackets open in this scope
        for i, t in enumerate(self.toks):
            if i == start and self.stack and self.stack[-1].kind == "type":
                self.member(i)
            if t.kind == "op":
                if t.text == "{":
                    scope = self.opens.pop(i, None) or Scope("block")
                    goes_on = scope.kind == "hidden" or scope.kind == "block" and (parens or self.is_(i - 1, "=", "]", ",", "{") and start < i)
                    scope.resume, scope.parens = start if goes_on else None, parens
                    self.stack.append(scope)
                    start, parens = i + 1, 0
                elif t.text == "}":
                    scope = self.stack.pop() if self.stack else Scope("block")
                    start, parens = (i + 1, 0) if scope.resume is None else (scope.resume, scope.parens)
                elif t.text == ";":
                    start = i + 1 if not parens else start
                elif t.text in "([":
                    parens += 1
                elif t.text in ")]":
                    parens = max(0, parens - 1)
                elif t.text == "->":
                    start = self.arrow(i, start, parens)
                elif t.text == ":" and not parens and self.is_(start, "case", "default") and sum(self.is_(k, "?") - self.is_(k, ":") for k in range(start, i)) <= 0:
                    start = i + 1
            elif t.kind == "word":
                self.use(i, t.text, start)

    def use(self, i: int, text: str, start: int) -> None:
        if text in _KINDS and self.word(i + 1) and not self.is_(i - 1, "."):
            return self.type_(i, start)
        if text in ("package", "import") and i == start and not self.stack:
            k = i + 1 + self.is_(i + 1, "static")
            end = self.dotted(k)
            if self.is_(end, ".") and self.is_(end + 1, "*"):
                end += 2
            if self.word(k) and self.is_(end, ";"):
                name = joined(self.toks[k:end])
                if text == "package":
                    self.package = name
                else:
                    self.rows["import"].append((self.raw(i), {"name": name, "package": self.package}))
            return None
        if text == "new":
            self.anonymous(i)
        if self.method() is None or i < self.hidden_to:
            return None
        if text == "return":
            return self.returned(i)
        if text in VERBS and self.is_(i + 1, "("):
            self.statement(i)
        inside = self.is_(i - 1, ".") and self.word(i - 2)  # of a dotted name
        if text not in _WORDS and not inside:
            if not self.is_(i - 1, "."):
                self.local(i)
            self.call(i)
        return None

    def parse(self) -> Facts:
        self.walk()
        fields = {(f["owner"], f["name"]): f["type"] for _, f in self.rows["java_field"]}
        uses, self.rows["statement_use"] = self.rows["statement_use"], []
        for at, u in uses:
            receiver, named = u.pop("receiver"), u.pop("named")
            if not any(m in x.lower() for m in MAPPER for x in (receiver, fields.get((u["owner"], receiver), ""))):
                continue
            own = [c for _, c in self.rows["java_constant"] if c["owner"] == u["owner"]]
            if named.kind == "string":
                picked = [(named.text[1:-1], "literal")]
            elif exact := [c["value"] for c in own if c["name"] == named.text]:
                picked = [(exact[0], "class-constant")]
            else:
                picked = [(c["value"], "class-constant-candidate") for c in own if any(n in c["name"].lower() for n in NAMING)]
            self.rows["statement_use"] += [(at, u | {"statement": value, "resolution": how, "confidence": SURE[how]}) for value, how in picked]
        for kind, rows in self.rows.items():
            for at, data in rows:
                self.out.add(kind, at, **data)
        return self.out


def parse(text: str) -> Facts:
    return Parser(text).parse()
