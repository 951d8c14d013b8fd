"""Source trees as DataFrames: a data source that lists and reads files, classification, ignore rules, fingerprints, fact cache."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.scratch import ready

# Languages by extension, directories that are never entered, size limit.
LANGUAGES = {
    ".java": ("java", "code"), ".jsp": ("jsp", "markup"), ".jspx": ("jsp", "markup"), ".js": ("javascript", "code"), ".mjs": ("javascript", "code"), ".html": ("html", "markup"),
    ".htm": ("html", "markup"), ".xml": ("xml", "config"), ".properties": ("properties", "config"), ".sql": ("sql", "data"), ".md": ("markdown", "docs"), ".txt": ("text", "docs"),
}
PRUNED = (".git", ".hg", ".svn", ".idea", ".vscode", "build", "dist", "node_modules", "out", "target", "vendor")
MAX_BYTES = 5 * 1024 * 1024
PARSED = ("java", "jsp", "javascript", "xml", "sql", "properties")
SCHEMA = "path string, language string, category string, size long, mtime_ms double, status string, sha256 string, content binary"


def glob_regex(pattern: str) -> str:
    """`**` crosses directories, `*` and `?` don't."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts) + "$"


class _Files(InputPartition):
    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.ignore = [re.compile(glob_regex(p)) for p in options.get("ignore", "").split("\n") if p.strip() and not p.startswith("#")]
        self.most, self.batch = int(options.get("maxbytes", MAX_BYTES)), int(options.get("batch", 200))
        self.content = options.get("content", "true") == "true"

    def _ignored(self, rel: str) -> bool:
        return any(p.match(rel) for p in self.ignore)

    def partitions(self) -> list[InputPartition]:
        """List names only; directories that are pruned or ignored are never entered, links never followed."""
        found, todo = [], [""]
        while todo:
            rel = todo.pop()
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    own = f"{rel}/{e.name}" if rel else e.name
                    if e.is_symlink():
                        found.append((own, "symbolic-link"))
                    elif e.is_dir(follow_symlinks=False):
                        if e.name not in PRUNED and not self._ignored(own + "/") and not self._ignored(own):
                            todo.append(own)
                    elif e.is_file(follow_symlinks=False) and not self._ignored(own):
                        known = os.path.splitext(own)[1].lower() in LANGUAGES
                        found.append((own, "" if known else "unsupported-file-type"))
        found.sort()
        return [_Files(found[k : k + self.batch]) for k in range(0, len(found), self.batch)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for rel, reason in partition.entries:
            language, category = LANGUAGES.get(os.path.splitext(rel)[1].lower(), (None, None))
            if reason:
                yield rel, language, category, None, None, reason, None, None
            else:
                yield self._one(rel, language, category)

    def _one(self, rel: str, language: str, category: str) -> tuple:
        full = os.path.join(self.root, rel)
        try:
            for _ in range(2):  # a file that changes while it is read is read once more
                before = os.lstat(full)
                if before.st_size > self.most:
                    return rel, language, category, before.st_size, before.st_mtime_ns / 1e6, "file-too-large", None, None
                if language not in PARSED or not self.content:
                    return rel, language, category, before.st_size, before.st_mtime_ns / 1e6, "metadata", None, None
                with open(full, "rb") as f:
                    data = f.read()
                after = os.lstat(full)
                if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns) and stat.S_ISREG(after.st_mode):
                    kind = "binary" if b"\0" in data else "parsed"
                    return rel, language, category, len(data), after.st_mtime_ns / 1e6, kind, hashlib.sha256(data).hexdigest(), data
            return rel, language, category, None, None, "unstable", None, None
        except OSError as e:
            return rel, language, category, None, None, f"operational-error:{e.strerror}", None, None


class ProjectSource(DataSource):
    """spark.read.format("weft_project").load(root): one row a file, with its status."""

    @classmethod
    def name(cls) -> str:
        return "weft_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """All files of a tree; status is parsed, binary, metadata, or why a file was skipped."""
    ready(spark)
    spark.dataSource.register(ProjectSource)
    own = os.path.join(root, ".weftignore")
    rules = [*ignore, *(open(own, encoding="utf-8").read().splitlines() if os.path.exists(own) else [])]
    return spark.read.format("weft_project").option("ignore", "\n".join(r.strip() for r in rules)).option("maxbytes", str(max_bytes)).load(root)


def language_of(path: Column) -> Column:
    """Language of a path by its extension, null if unsupported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(*(F.when(ext == k, F.lit(v[0])) for k, v in LANGUAGES.items()))


def ignored(path: Column, patterns: list[str]) -> Column:
    out = F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(*PRUNED))
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def split_by_cache(files: DataFrame, cache: DataFrame | None, parser_version: str) -> tuple[DataFrame, DataFrame | None]:
    """(files to parse, cached facts that still hold): a fact row is reused for the same path, content hash and parser version."""
    if cache is None:
        return files, None
    live = cache.where(F.col("parser_version") == parser_version)
    keys = live.select("path", "sha256").distinct()
    return files.join(keys, ["path", "sha256"], "left_anti"), live.join(files.select("path", "sha256"), ["path", "sha256"], "left_semi")

