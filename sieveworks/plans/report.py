"""Reports for people and machines. Rows are cut and ordered in Spark; only what is shown reaches the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks import __version__
from sieveworks.operators import scoring

SHOWN = 20
TITLES = {
    "answers": "Wrong or outdated answers", "exposure": "Privacy and security exposure", "invisible": "Content that cannot be read",
    "chunking": "Meaning lost in chunking", "collection": "Collection structure", "other": "Other",
}


def exit_code(findings: DataFrame, fail_on: str = "error") -> int:
    """1 if some finding is as severe as ``fail_on`` or a check was not done; 'never' is always 0."""
    if fail_on == "never":
        return 0
    worst = [s for s, r in scoring.RANK.items() if r <= scoring.RANK[fail_on]]
    return int(not findings.filter(F.col("severity").isin(worst) | F.col("check").rlike(scoring.UNDONE)).limit(1).isEmpty())


def shown(findings: DataFrame, limit: int | None = SHOWN, info: bool = False) -> list:
    rows = findings if info else findings.filter("severity <> 'info'")
    rows = rows.withColumn("tag", scoring.tag()).orderBy(*scoring.report_key(), "finding_id")
    return list(rows.toLocalIterator()) if limit is None else rows.limit(limit).collect()


def to_json(report: DataFrame, findings: DataFrame, root: str, limit: int | None = None, docs: DataFrame | None = None) -> str:
    """All findings, and the documents with their scores if they are given; partitions come to the driver one at a time."""
    r = report.first().asDict()
    rows = [x.asDict() for x in shown(findings, limit, info=True)]
    keep = ("check", "severity", "f_codes", "title", "path", "location", "detail", "fix", "related")
    counts = {s: r[f"n_{s}"] for s in scoring.RANK}
    head = {"tool": "sieveworks", "version": __version__, "root": root, "score": r["score"], "verdict": r["verdict"], "counts": counts}
    if docs is not None:
        scored = scoring.document_scores(docs, findings).join(docs.select("path", "read_error", *(["fmt"] if "fmt" in docs.columns else [])), "path").orderBy("path")
        head["documents"] = [x.asDict() for x in scored.toLocalIterator()]
    return json.dumps(head | {"findings": [{k: x[k] for k in keep} for x in rows]}, ensure_ascii=False, indent=2)


def _score(r) -> str:
    return "no score" if r["score"] is None else f"{r['score']}/100"


def _where(x) -> str:
    linked = x["related"] and x["check"] in ("version-conflict", "version-stale", "duplicate")
    return x["path"] + (f" {x['location']}" if x["location"] else "") + ("  ↔  " + ", ".join(x["related"][:2]) if linked else "")


def to_markdown(report: DataFrame, findings: DataFrame, root: str, limit: int | None = None) -> str:
    r = report.first()
    cell = lambda s: str(s).replace("|", "\\|").replace("\n", " ")
    rows = [f"| {x['severity']} | {x['check']} | {cell(_where(x))} | {cell(x['title'])} |" for x in shown(findings, limit)]
    return "\n".join([f"# Corpus report: {_score(r)}, {r['verdict']}", "", f"`{root}`: {r['documents']} documents, {r['n_error']} errors, {r['n_warn']} warnings", "", "| severity | check | where | finding |", "|---|---|---|---|", *rows, ""])


def to_text(report: DataFrame, findings: DataFrame, root: str, show_all: bool = False, utf8: bool = True) -> str:
    r = report.first()
    signs = {"error": "✗", "warn": "!", "info": "·"} if utf8 else {"error": "x", "warn": "!", "info": "-"}
    rows = shown(findings, None if show_all else SHOWN, info=show_all)
    body = [f"{signs[x['severity']]} {x['tag']:<12} {_where(x)}\n    {x['title']}" for x in rows]
    left = r["n_error"] + r["n_warn"] - len(rows)
    tail = [f"... and {left} more"] if not show_all and left > 0 else []
    first = [f"Fix first: {_where(rows[0])}"] if rows else []
    return "\n".join([f"{root}: {r['documents']} documents", *body, *tail, "", f"{_score(r)} {r['verdict']}: {r['n_error']} errors, {r['n_warn']} warnings, {r['n_info']} notes", *first])


def to_html(docs: DataFrame, report: DataFrame, findings: DataFrame, root: str, limit: int = 2000) -> str:
    """Category cards, the network of the worst documents, a heat map of pages and the findings."""
    r = report.first()
    e = html.escape
    cats = {x["c"]: x["n"] for x in findings.filter("severity <> 'info'").groupBy(scoring.category().alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cards = "".join(f"<div class=card><b>{n}</b> {e(TITLES[c])}</div>" for c, n in sorted(cats.items(), key=lambda x: -x[1]))
    nodes = scoring.graph_nodes(docs, findings).filter("status <> 'clean'").orderBy(F.desc("n_error"), F.desc("n_warn"), "path").limit(limit).collect()
    edges = scoring.graph_edges(findings).orderBy("a", "b", "kind").limit(limit).collect()
    heat = scoring.pages(findings.filter("severity <> 'info'").withColumn("id", F.monotonically_increasing_id())).select("id", "path", "page").distinct().groupBy("path", "page").agg(F.count(F.lit(1)).alias("n")).orderBy("path", "page").limit(limit).collect()
    rows = "".join(f"<tr class={x['severity']}><td>{e(x['tag'])}<td>{e(_where(x))}<td>{e(x['title'])}<td>{e(x['fix'])}" for x in shown(findings, limit, info=True))
    data = json.dumps({"nodes": [n.asDict() for n in nodes], "edges": [x.asDict() for x in edges], "pages": [h.asDict() for h in heat]}, ensure_ascii=False).replace("</", "<\\/")
    return (
        f"<!doctype html><meta charset=utf-8><title>Corpus report</title><style>body{{font:14px sans-serif;margin:2em}}.card{{display:inline-block;padding:1em;margin:.3em;border:1px solid #ccc}}td{{padding:.3em;border-top:1px solid #ddd}}.error td:first-child{{color:#b00}}</style>"
        f"<h1>{_score(r)} {e(r['verdict'])}</h1><p>{e(root)}: {r['documents']} documents, {r['n_error']} errors, {r['n_warn']} warnings</p>{cards}"
        f"<input placeholder=filter oninput=\"for(const t of document.querySelectorAll('tr'))t.hidden=!t.textContent.toLowerCase().includes(this.value.toLowerCase())\"><table>{rows}</table><script type=application/json id=data>{data}</script>"
    )


def explain(code: str) -> str | None:
    mode = scoring.MODES.get(code.upper())
    return None if mode is None else f"{code.upper()}: {mode[1]} ({mode[0]}, evidence {mode[2].lower()}{', checked here' if code.upper() in scoring.COVERED else ''})"
