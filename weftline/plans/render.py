"""Markdown and diagrams from bounded results, and JSON export of a graph. Rows are ordered before they are written."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from weftline.operators.traverse import Trace
from weftline.plans.docmodel import Model
from weftline.plans.resolve import Graph

# Fixed values.
BUDGET, PROVEN, NOTICE = 256 * 1024, 0.95, "... more was left out: the size limit of this document is reached"
DIAGRAM_NODES = 30


def inline(text: str) -> str:
    return re.sub(r"([\\`\[\]<>])", r"\\\1", re.sub(r"[\x00-\x1f\x7f]+", " ", text))[: 32 * 1024]


def within_budget(lines: list[str], budget: int = BUDGET) -> str:
    """The first lines that fit, then a notice; an open code fence is closed."""
    out, used, fence = [], 0, False
    spare = len(NOTICE.encode()) + 8
    for line in lines:
        n = len(line.encode()) + 1
        if used + n > budget - spare:
            return "\n".join([*out, *(["```"] if fence else []), NOTICE, ""])
        out.append(line)
        used += n
        fence ^= line.startswith("```")
    return "\n".join([*out, ""])


def trace_markdown(trace: Trace, graph: Graph, title: str, budget: int = BUDGET) -> str:
    """Paths, then relations by certainty: proven, configured candidates, heuristic."""
    kinds = {"proven": [], "configured": [], "heuristic": []}
    for e in graph.edges.where(graph.edges["id"].isin(sorted(trace.edges)[:5000])).orderBy("id").limit(500).collect():
        kind = "configured" if e["type"] in ("forwards_to", "redirects_to", "uses_tile") else "proven" if e["confidence"] >= PROVEN else "heuristic"
        proof = e["evidence"][0] if e["evidence"] else None
        kinds[kind].append(f"- {inline(e['source'])} {e['type']} {inline(e['target'])} ({e['confidence']:g})" + (f" `{proof['file']}:{proof['line']}`" if proof else ""))
    lines = [f"# {inline(title)}", "", f"States {trace.expanded}, paths {len(trace.paths)}" + "".join(f", {n} limit reached" for n, on in (("state", trace.state_limit), ("path", trace.path_limit), ("depth", trace.depth_limit)) if on), ""]
    lines += ["## Paths", "", *(f"{i}. " + " -> ".join(map(inline, p["nodes"])) for i, p in enumerate(trace.paths[:12], 1)), ""]
    for kind, rows in kinds.items():
        lines += [f"## {kind.capitalize()}", "", *(rows or ["none"]), ""]
    return within_budget(lines, budget)


def use_case_markdown(model: Model, budget: int = BUDGET) -> str:
    lines, module = ["# Use cases", ""], None
    for c in model.use_cases.orderBy("module", "route").collect():
        if c["module"] != module:
            module = c["module"]
            lines += [f"## Module {inline(module)}", ""]
        lines += [f"### {inline(c['route'])}", "", f"Confidence {c['confidence']:g}" + (" (flow cut)" if c["flow_truncated"] else ""), ""]
        lines += [f"- from {inline(t['source'])} by {t['type']}" for t in c["triggers"] or []]
        lines += [f"{i}. {inline(n)}" for i, n in enumerate(c["main_flow"] or [], 1)]
        lines += [f"- table {inline(t['table'])}: {t['access']}" for t in c["tables"] or []]
        lines += [f"- statement {inline(s)}" for s in c["statements"]]
        lines += [f"- outcome {inline(o['name'])}: {inline(o['target'])}" for o in c["outcomes"] or []] + [""]
    return within_budget(lines, budget)


def page_markdown(model: Model, budget: int = BUDGET) -> str:
    lines = ["# Pages", ""]
    for p in model.pages.orderBy("name").collect():
        lines += [f"## {inline(p['name'])}", ""]
        if "fields" in model.pages.columns:
            lines += [f"- field {inline(f['name'])} ({f['type']})" + (f" = {inline(f['default'])}" if f["default"] else "") for f in p["fields"] or []]
        lines += [f"- calls {inline(a)}" for a in p["actions"] or []] + [f"- shown by {inline(a)}" for a in p["arrivals"] or []] + [""]
    return within_budget(lines, budget)


def navigation_diagram(graph: Graph, most: int = DIAGRAM_NODES) -> str:
    """Mermaid flowchart of pages and routes, at most `most` edges by id."""
    rows = graph.edges.where("type in ('submits_to', 'links_to', 'requests', 'forwards_to', 'redirects_to')").orderBy("id").limit(most).collect()
    names = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for r in rows for x in (r["source"], r["target"])))}
    label = lambda t: re.sub(r"[^\w ./:-]+", " ", t)[:60]
    return "\n".join(["```mermaid", "flowchart LR", *(f'  {v}["{label(k)}"]' for k, v in names.items()), *(f"  {names[r['source']]} -->|{r['type']}| {names[r['target']]}" for r in rows), "```", ""])


def write_atomic(path: str, text: str) -> None:
    """Replace a file as a whole, or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, own = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, target)
    except BaseException:
        Path(own).unlink(missing_ok=True)
        raise


def graph_json(graph: Graph) -> str:
    """A graph of moderate size as one sorted document, the same for every run."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.orderBy("id").collect()]
    nodes, edges = rows(graph.nodes), rows(graph.edges)
    count = lambda xs: {t: sum(x["type"] == t for x in xs) for t in sorted({x["type"] for x in xs})}
    warnings = sorted(f"{r['code']} {r['subject']}" for r in graph.warnings.collect())
    return json.dumps({"schemaVersion": "1.0.0", "summary": {"nodes": count(nodes), "edges": count(edges)}, "nodes": nodes, "edges": edges, "warnings": warnings}, indent=2, ensure_ascii=False, sort_keys=True) + "\n"
