"""Fact extraction: one function for each language, and the table function that applies them to files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import java, properties, sql, web, xml
from .base import FACTS, Facts

#: A new version of any parser makes cached facts of all files stale.
VERSION = "2"
PARSERS: dict[str, Callable[[str], Facts]] = {"java": java.parse, "jsp": web.parse, "javascript": web.parse_script, "xml": xml.parse, "sql": sql.parse, "properties": properties.parse}
_COLUMNS = ["path", "sha256", "parser_version", "kind", "ord", "line", "col", "snippet", "data"]
SCHEMA = f"path string, sha256 string, parser_version string, {FACTS}"


def facts(files: DataFrame, parsers: dict[str, Callable[[str], Facts]] | None = None) -> DataFrame:
    """Facts of all parsed files, one row each; a file that its parser can't read gives one `error` row and others go on. Each file has a row `file` too, so one without facts is known to be parsed."""
    use = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, digest, content in zip(pdf["path"], pdf["language"], pdf["sha256"], pdf["content"], strict=True):
                try:
                    found = use[language](bytes(content).decode("utf-8", "replace")).rows
                except Exception as e:  # one bad file must not end the job
                    found = [("error", 0, 1, 1, "", {"message": re.sub(r"(?:[A-Za-z]:)?/[^\s'\"]+", "<path>", str(e))[:500], "type": type(e).__name__})]
                rows += [(path, digest, VERSION, *f) for f in (("file", -1, 1, 1, "", {"language": language}), *found)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.where("status = 'parsed'").select("path", "language", "sha256", "content").mapInPandas(run, SCHEMA)
