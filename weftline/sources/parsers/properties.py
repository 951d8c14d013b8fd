"""Java properties files."""

from __future__ import annotations

import re

from .base import Facts, Source

# Limits.
MAX_ENTRIES, MAX_CHARS = 10_000, 64 * 1024
_ENTRY = re.compile(r"((?:\\.|[^\\=:\s])*)(?:\s*[=:]|\s)?\s*(.*)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _decode(text: str) -> str:
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _PLAIN.get(m[2], m[2]), text, flags=re.S)


def parse(text: str) -> Facts:
    """Entries key, value; a line that ends in an odd number of backslashes goes on in the next."""
    out = Facts(Source(text, cr=True))
    lines = list(re.finditer(r"([^\r\n]*)(\r\n|\n|\r|\Z)", text))
    k = n = 0
    while k < len(lines):
        at, logical = lines[k].start(), lines[k][1]
        while len(logical) - len(logical.rstrip("\\")) & 1 and k + 1 < len(lines):
            k += 1
            logical = logical[:-1] + lines[k][1].lstrip()
        k += 1
        logical = logical.lstrip()
        if not logical or logical[0] in "#!":
            continue
        if n >= MAX_ENTRIES:
            out.warn("entries-truncated", at)
            break
        m = _ENTRY.match(logical)
        key, value = _decode(m[1]), _decode(m[2])
        if not key:
            continue
        if max(len(key), len(value)) > MAX_CHARS:
            out.warn("oversized-entry", at)
            continue
        out.add("property", at, key=key, value=value)
        n += 1
    return out
