"""Command line: ``scan PATH``, ``chunks EXPORT``, ``ab PATH -q QUESTIONS``, ``explain CODE``, ``coverage``."""

from __future__ import annotations

import argparse
import sys
from datetime import date
from pathlib import Path

from sieveworks.operators import chunking, export_lint, retrieval, scoring
from sieveworks import storage
from sieveworks.plans import report, scan


def _session(scratch: str | None = None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("sieveworks").config("spark.sql.session.timeZone", "UTC")
    return (builder.config(storage.FOLDER, scratch) if scratch else builder).getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveworks", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "chunks"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--format", choices=["text", "json", "md", "html"], default="text")
        s.add_argument("--out")
        s.add_argument("--fail-on", choices=["error", "warn", "info", "never"], default="error")
        s.add_argument("--all", action="store_true")
        s.add_argument("--scratch", help="folder shared by all executors, where the session names none")
        if name == "scan":
            s.add_argument("--only")
            s.add_argument("--skip", default="")
            s.add_argument("--chunker", default="langchain")
        else:
            s.add_argument("--max-tokens", type=int, default=export_lint.MAX_TOKENS)
    ab = sub.add_parser("ab")
    ab.add_argument("path")
    ab.add_argument("-q", "--questions", required=True)
    ab.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    ab.add_argument("--chunker", default="langchain")
    ab.add_argument("--scratch")
    sub.add_parser("explain").add_argument("code")
    sub.add_parser("coverage")
    return p


def _documents(spark, path: str):
    from sieveworks.sources.files import read_documents, with_text

    return with_text(read_documents(spark, path)).cache()


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("scan", "chunks", "ab", "explain", "coverage", "-h", "--help"):
        argv.insert(0, "scan")  # a bare path
    a = _parser().parse_args(argv)
    if a.command == "explain":
        text = report.explain(a.code)
        print(text or f"unknown code {a.code}")
        return 0 if text else 2
    if a.command == "coverage":
        print("\n".join(f"{'x' if k in scoring.COVERED else ' '} {k} {v[1]}" for k, v in scoring.MODES.items()))
        return 0
    if not Path(a.path).exists():
        print(f"no such path: {a.path}", file=sys.stderr)
        return 2
    spark = _session(a.scratch)
    if a.command == "chunks":
        from sieveworks.sources.files import read_export

        from pyspark.sql import functions as F

        docs = read_export(spark, a.path).withColumn("chunk_id", F.col("i"))
        found = export_lint.findings(docs, a.max_tokens).withColumn("finding_id", F.xxhash64("check", "path", "title")).cache()
        summary = scoring.export_report(found).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))  # one row each
        pages = docs.select(F.coalesce("source", F.lit(export_lint.NO_SOURCE)).alias("path"), F.lit(None).cast("string").alias("read_error")).distinct()
    else:
        docs = _documents(spark, a.path)
        if docs.isEmpty():
            print(f"no supported files below {a.path}", file=sys.stderr)
            return 2
        options = scan.Options(date.today().year, a.chunker)
        if a.command == "ab":
            from sieveworks.sources.files import read_questions

            found, _ = scan.scan(docs, options)
            name, *sizes = chunking.parse_spec(a.chunker)
            size, overlap = sizes if name == "langchain" else chunking.PRESETS["langchain"]
            hits = retrieval.compare(retrieval.before_index(docs, size, overlap), retrieval.after_index(docs, found, size, overlap), read_questions(spark, a.questions), a.top_k)
            for x in hits.orderBy("query_id", "side", "rank").toLocalIterator():
                print(f"{x['query_id']}\t{x['side']}\t{x['rank']}\t{x['chunk_id']}\t{x['score']}")
            return 0
        found, summary = scan.scan(docs, options, a.only.split(",") if a.only else None, [x for x in a.skip.split(",") if x])
        pages = docs.select("path", "read_error", "fmt")
    fmt = {".json": "json", ".md": "md", ".html": "html"}.get(Path(a.out).suffix, a.format) if a.out else a.format
    text = {
        "text": lambda: report.to_text(summary, found, a.path, a.all, (sys.stdout.encoding or "").lower().startswith("utf")), "json": lambda: report.to_json(summary, found, a.path, docs=pages),
        "md": lambda: report.to_markdown(summary, found, a.path), "html": lambda: report.to_html(pages, summary, found, a.path),
    }[fmt]()
    Path(a.out).write_text(text, encoding="utf-8") if a.out else print(text)
    return report.exit_code(found, a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
