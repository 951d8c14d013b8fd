"""Commands: analyze, overview, search, trace-*, docs, validate-doc. `python -m weftline.cli VERB TARGET [TERM]`."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import search, traverse
from weftline.plans import docmodel, index, render

# Exit codes.
OK, ERROR, NO_MATCH, INVALID = 0, 2, 3, 4
MODES = tuple(traverse.MODES)


def _analyze(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    got = index.analyze(spark, a.target, f"{a.target}/.weft/facts")
    index.save(got.graph, a.output or f"{a.target}/.weft/index")
    if a.json:
        return OK, [json.dumps({"files": got.statuses, "reused": got.reused, "millis": {k: round(v) for k, v in got.millis.items()}, "diagnostics": got.diagnostics}, sort_keys=True)]
    return OK, [f"{s}: {n}" for s, n in sorted(got.statuses.items())] + [f"reused: {got.reused}", f"total: {got.millis['total']:.0f} ms", *got.diagnostics]


def _overview(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    rows = index.summary(index.load_or_build(spark, a.target)).orderBy(F.desc("what"), "type").collect()
    return OK, [f"{r['what']} {r['type']}: {r['n']}" for r in rows]


def _search(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    rows = search.search(index.load_or_build(spark, a.target).nodes, index.checked_query(a.term)).collect()
    first = lambda r: f"; {r['evidence'][0]['file']}:{r['evidence'][0]['line']}" if r["evidence"] else ""
    return (OK if rows else NO_MATCH), [f"{r['id']} (score {r['score']}){first(r)}" for r in rows]


def _trace(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    graph, term = index.load_or_build(spark, a.target), index.checked_query(a.term)
    found = traverse.trace(graph.nodes, graph.edges, term, a.verb.removeprefix("trace-"))
    if not found.matches:
        return NO_MATCH, ["no match"]
    return OK, [*render.trace_markdown(found, graph, term).splitlines(), *found.warnings]


def _docs(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    graph = index.load_or_build(spark, a.target)
    query = index.query_file(a.target, a.query_file) if a.query_file else None
    model = docmodel.build(graph, None, query)
    if query and model.use_cases.isEmpty():
        return NO_MATCH, ["no match"]
    scope = spark.range(1).select(tx.slug(F.lit(query or "")).alias("s")).first()["s"] if query else "all"
    out = Path(a.output or f"{a.target}/.weft/docs") / scope
    for name, text in (("use-cases.md", render.use_case_markdown(model)), ("pages.md", render.page_markdown(model)), ("navigation.md", render.navigation_diagram(graph))):
        render.write_atomic(str(out / name), text)
    return OK, [str(out / n) for n in ("use-cases.md", "pages.md", "navigation.md")]


def _validate(spark: SparkSession, a: argparse.Namespace) -> tuple[int, list[str]]:
    root, counts = Path(a.target), {}
    text = (root / a.term).read_text(encoding="utf-8")
    for path in {p for p, _ in docmodel.cited(text)}:
        file = root / path
        if not path.startswith("/") and ".." not in path.split("/") and file.is_file() and not file.is_symlink():
            counts[path] = len(file.read_text(encoding="utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    wrong = docmodel.check_document(text, counts)
    return (INVALID if wrong else OK), wrong or ["valid"]


VERBS: dict[str, Callable] = {"analyze": _analyze, "overview": _overview, "search": _search, **{f"trace-{m}": _trace for m in MODES}, "docs": _docs, "validate-doc": _validate}


def run(spark: SparkSession, argv: list[str]) -> tuple[int, list[str]]:
    """Exit code and lines of a command."""
    parser = argparse.ArgumentParser(prog="weftline", exit_on_error=False)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("target")
    parser.add_argument("term", nargs="?", default="")
    parser.add_argument("--output")
    parser.add_argument("--query-file")
    parser.add_argument("--json", action="store_true")
    try:
        a = parser.parse_args(argv)
        return VERBS[a.verb](spark, a)
    except index.Invalid as e:
        return ERROR, [f"error: {x}" for x in e.args]
    except (argparse.ArgumentError, OSError, PySparkException) as e:
        return ERROR, [f"error: {type(e).__name__}"]


def main() -> int:
    code, lines = run(SparkSession.builder.appName("weftline").getOrCreate(), sys.argv[1:])
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
