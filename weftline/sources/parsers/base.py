"""What parsers share: evidence positions, masking, fact rows."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

#: One schema for all facts; a kind's fields are in data, its lists joined by newlines.
FACTS = "kind string, ord int, line int, col int, snippet string, data map<string,string>"


@dataclass
class Source:
    """A file's text with the positions of its line starts; with cr a bare carriage return ends a line too."""

    text: str
    cr: bool = False
    starts: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n" if self.cr else r"\n", self.text))]

    def _line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset) - 1

    def line_begin(self, offset: int) -> int:
        return self.starts[self._line(offset)]

    def at(self, offset: int) -> tuple[int, int, str]:
        """Line and column from 1, the column in UTF-16 units, and the line trimmed."""
        k = self._line(offset)
        begin = self.starts[k]
        line = self.text[begin : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)]
        return k + 1, 1 + len(self.text[begin:offset].encode("utf-16-le", "surrogatepass")) // 2, line.strip()

    def offset_at(self, line: int, column: int) -> int:
        """The position of a line and column, the inverse of at; within the text and the line."""
        k = min(max(line, 1), len(self.starts)) - 1
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        units, at = column - 1, self.starts[k]
        while units > 0 and at < end:
            units -= 1 + (ord(self.text[at]) > 0xFFFF)
            at += 1
        return at


def blank(text: str, pattern: re.Pattern) -> str:
    """text with matches as spaces, line ends kept, so that offsets hold."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


@dataclass
class Facts:
    source: Source
    rows: list[tuple] = field(default_factory=list)

    def add(self, kind: str, offset: int, /, **data) -> None:
        line, col, snippet = self.source.at(offset)
        shown = {k: "\n".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in data.items() if v is not None}
        self.rows.append((kind, len(self.rows), line, col, snippet, shown))

    def warn(self, code: str, offset: int = 0, /, **data) -> None:
        self.add("warning", offset, code=code, **data)
