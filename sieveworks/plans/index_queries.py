"""Queries over the exported index, retrieval, versions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import dedup, export_lint, retrieval, scoring, versions
from sieveworks.plans import scan
from sieveworks.plans.text_queries import AS_OF_YEAR, SP, W
from sieveworks.plans.text_queries import ORACLE as TEXT_ORACLE
from sieveworks.sources import tables
from sieveworks.storage import materialize

CHUNKS_SQL = "c AS (SELECT * EXCLUDE (source, page), nullif(source, '') AS source, nullif(page, '') AS page FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1) WHERE text IS NOT NULL)"
FIND_SQL = "f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC) = 1)"
DOCS_SQL = "d AS (SELECT path, read_error FROM documents UNION ALL SELECT path, read_error FROM kb_files)"


def q_export_order(spark, d):
    o = export_lint.ordered(tables.chunks(spark, d))
    return o.select("chunk_id", "src", F.col("n").cast("long").alias("n"), F.md5("next_text").alias("next_digest"))


def q_export_splits(spark, d):
    p = export_lint.pairs(tables.chunks(spark, d))
    return p.filter("qualifier <> ''").select("src", F.col("n").cast("long").alias("n"), "chunk_id", "qualifier")


def q_export_open_ends(spark, d):
    p = export_lint.pairs(tables.chunks(spark, d))
    return p.groupBy("src").agg(F.count_if("open_end").alias("open_ends"), F.count(F.lit(1)).alias("pairs"))


def q_export_tables(spark, d):
    return export_lint.table_goes_on(export_lint.pairs(tables.chunks(spark, d))).select("src", F.col("n").cast("long").alias("n"), "header")


def q_export_tokens(spark, d):
    return tables.chunks(spark, d).select("chunk_id", export_lint.tokens().alias("tokens"), (export_lint.tokens() > 512).alias("oversize"), (T.word_count("text") < export_lint.TINY_WORDS).alias("tiny"))


def q_export_duplicates(spark, d):
    return export_lint.duplicates(tables.chunks(spark, d))


def q_export_sources(spark, d):
    c = tables.chunks(spark, d).withColumn("src", F.coalesce("source", F.lit(export_lint.NO_SOURCE)))
    return c.groupBy("src").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("ord").isNull()).alias("without_order"))


def q_export_findings(spark, d):
    return export_lint.findings(tables.chunks(spark, d), 512).select("check", "severity", F.array_join("f_codes", ",").alias("codes"), "title", "path", "location")


def q_export_report(spark, d):
    f = materialize(export_lint.findings(tables.chunks(spark, d), 512).select("severity"), "export")
    return scoring.export_report(f)


def _questions(spark, d):
    return tables.table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question")


def q_bm25(spark, d):
    c = tables.chunks(spark, d).select("chunk_id", "text")
    return retrieval.bm25(c, _questions(spark, d)).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def q_before_after(spark, d):
    docs = materialize(tables.corpus(spark, d).select("path", "fmt", "metadata", "read_error", "text"), "corpus")  # both indexes read it
    f = materialize(scan_findings(spark, d), "findings")
    hits = retrieval.compare(retrieval.before_index(docs), retrieval.after_index(docs, f), _questions(spark, d))
    return hits.select("side", "query_id", "rank", "chunk_id", "score")


def q_after_index(spark, d):
    docs = tables.corpus(spark, d)
    return retrieval.after_index(docs, materialize(scan_findings(spark, d), "findings")).select("path", "chunk_no", F.md5("chunk").alias("digest"), F.length("chunk").alias("chars"))


def q_file_names(spark, d):
    n = versions.names(tables.readable(tables.documents(spark, d)))
    return n.select("path", "key", "label", F.array_join("marks", ",").alias("marks"), F.array_join(F.transform("date", lambda x: x.cast("string")), "-").alias("date"), "date_src", "title", "status")


def q_version_families(spark, d):
    m, f = versions.families(tables.readable(tables.documents(spark, d)))
    return m.select("family", "path").join(f, "family").select("family", "path", "members", "is_period", F.round("max_sim", 6).alias("max_sim"))


def q_version_findings(spark, d):
    return versions.findings(tables.documents(spark, d)).select("check", "severity", F.array_join("f_codes", ",").alias("codes"), "title", "path", F.array_join("related", ",").alias("related"))


def scan_findings(spark, d):
    """All checks over documents and files with their pages, as one table of findings; a check that fails ends the query."""
    return scan.findings(tables.corpus(spark, d), scan.Options(AS_OF_YEAR), strict=True)


def q_scan_findings(spark, d):
    return scan_findings(spark, d).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_scan_report(spark, d):
    f = materialize(scan_findings(spark, d), "findings")
    return scoring.scan_report(_docs(spark, d), f)


def _findings(spark, d):
    return tables.latest(tables.table(spark, d, "findings"), "finding_id")


def _docs(spark, d):
    return tables.documents(spark, d).select("path", "read_error").unionByName(tables.table(spark, d, "kb_files").select("path", "read_error"))


def q_doc_scores(spark, d):
    return scoring.document_scores(_docs(spark, d), _findings(spark, d))


def q_corpus_report(spark, d):
    return scoring.corpus_report(_docs(spark, d), _findings(spark, d))


def q_severity_counts(spark, d):
    return scoring.severity_counts(_findings(spark, d))


def q_category_counts(spark, d):
    return _findings(spark, d).groupBy(scoring.category().alias("category")).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in scoring.RANK])


def q_mode_counts(spark, d):
    return scoring.mode_counts(_findings(spark, d), spark)


def q_taxonomy(spark, d):
    return scoring.taxonomy(spark)


def q_top_findings(spark, d):
    return scoring.top_findings(_findings(spark, d)).select("finding_id", "check", "severity", "path", scoring.tag().alias("tag"))


def q_finding_pages(spark, d):
    return scoring.pages(_findings(spark, d)).select("path", scoring.category().alias("category"), "page").distinct()


def q_graph_edges(spark, d):
    return scoring.graph_edges(_findings(spark, d))


def q_graph_nodes(spark, d):
    return scoring.graph_nodes(_docs(spark, d), _findings(spark, d))


def q_json_report(spark, d):
    return _findings(spark, d).select("finding_id", F.to_json(F.struct("check", "severity", "f_codes", "title", "path", "location", "detail", "fix", "related")).alias("json"))


def q_report_lines(spark, d):
    s = F.concat(F.col("path"), F.when(F.col("location") != "", F.concat(F.lit(" "), "location")).otherwise(""))
    linked = F.col("check").isin("version-conflict", "version-stale", "duplicate") & (F.size("related") > 0)
    where = F.concat(s, F.when(linked, F.concat(F.lit("  ↔  "), F.array_join(F.slice("related", 1, 2), ", "))).otherwise(""))
    return _findings(spark, d).filter("severity <> 'info'").select("finding_id", scoring.tag().alias("tag"), F.replace(where, F.lit("|"), F.lit("\\|")).alias("line"))


def q_dedup_findings(spark, d):
    return dedup.exact_duplicates(tables.readable(tables.documents(spark, d))).select(F.lit("duplicate").alias("check"), F.lit("warn").alias("severity"), F.concat(F.lit("Exact duplicate of "), "first_path").alias("title"), "path")


def _case(values: dict, c: str, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


WEIGHT_SQL, CAP_SQL, RANK_SQL = (_case(x, "severity", "0") for x in (scoring.WEIGHT, scoring.CAP, scoring.RANK))
IMPACT_SQL = _case({c: k for k, c in enumerate(scoring.IMPACT)}, '"check"', str(len(scoring.IMPACT)))
CATEGORY_SQL = _case({c: k for k, cs in scoring.CATEGORIES.items() for c in cs}, '"check"', "'other'")
TAG_SQL = _case(scoring.TAGS, '"check"', 'left(upper("check"), 12)')
SCORES_SQL = f"""WITH {FIND_SQL}, {DOCS_SQL}, t AS (SELECT "check", severity, unnest(list_concat(CASE WHEN coalesce(path, '') IN ('', '(corpus)') THEN [] ELSE [path] END, CASE WHEN "check" LIKE 'version-conflict%' THEN coalesce(related, []) ELSE [] END)) AS path FROM f),
p AS (SELECT path, "check", least(sum({WEIGHT_SQL}), max({CAP_SQL})) AS penalty FROM t GROUP BY ALL), s AS (SELECT path, CAST(sum(penalty) AS BIGINT) AS penalty FROM p GROUP BY path),
sc AS (SELECT d.path, CASE WHEN read_error IS NOT NULL THEN 0 ELSE greatest(0, 100 - coalesce(penalty, 0)) END AS score, coalesce(penalty, 0) AS penalty FROM d LEFT JOIN s USING (path))"""
TERMS_SQL = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in retrieval.STOP) + "))"
NEXT_SQL = f"WITH {CHUNKS_SQL}, o AS (SELECT chunk_id, i, text, coalesce(source, '(no source)') AS src, row_number() OVER w AS n, lead(text) OVER w AS next_text FROM c WINDOW w AS (PARTITION BY coalesce(source, '(no source)') ORDER BY \"order\" ASC NULLS LAST, i, chunk_id))"

QUERIES = {
    "export_order": q_export_order, "export_splits": q_export_splits, "export_open_ends": q_export_open_ends, "export_tables": q_export_tables, "export_tokens": q_export_tokens, "export_duplicates": q_export_duplicates, "export_sources": q_export_sources,
    "export_findings": q_export_findings, "export_report": q_export_report, "bm25_topk": q_bm25, "before_after": q_before_after, "after_index": q_after_index, "file_names": q_file_names, "version_families": q_version_families, "version_findings": q_version_findings,
    "scan_findings": q_scan_findings, "scan_report": q_scan_report, "doc_scores": q_doc_scores, "corpus_report": q_corpus_report, "severity_counts": q_severity_counts, "category_counts": q_category_counts, "mode_counts": q_mode_counts, "taxonomy": q_taxonomy,
    "top_findings": q_top_findings, "finding_pages": q_finding_pages, "graph_edges": q_graph_edges, "graph_nodes": q_graph_nodes, "json_report": q_json_report, "report_lines": q_report_lines, "duplicate_findings": q_dedup_findings,
}

_MODES_VALUES = ", ".join(f"('{k}', '{s}', '{n}', '{g}', {str(k in scoring.COVERED).lower()})" for k, (s, n, g) in scoring.MODES.items())
TERMINAL_SQL = export_lint.TERMINAL.replace("'", "''")

ORACLE = {
    "export_order": NEXT_SQL + " SELECT chunk_id, src, n, md5(next_text) AS next_digest FROM o",
    "export_open_ends": NEXT_SQL + f" SELECT src, count(*) FILTER (regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g') <> '' AND NOT regexp_matches(text, '{TERMINAL_SQL}')) AS open_ends, count(*) AS pairs FROM o WHERE next_text IS NOT NULL GROUP BY src",
    "export_tokens": f"WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, len(regexp_extract_all(text, '{W}')) AS n FROM c) SELECT chunk_id, CAST(round_even(n * 1.33, 0) AS BIGINT) AS tokens, round_even(n * 1.33, 0) > 512 AS oversize, n < 5 AS tiny FROM w",
    "export_duplicates": f"WITH {CHUNKS_SQL}, k AS (SELECT chunk_id, i, sha1(lower(trim(regexp_replace(text, '[{SP}]+', ' ', 'g')))) AS h FROM c WHERE len(regexp_extract_all(text, '{W}')) >= 5), r AS (SELECT *, first_value(chunk_id) OVER (PARTITION BY h ORDER BY i, chunk_id) AS first_id, count(*) OVER (PARTITION BY h) AS copies FROM k) SELECT chunk_id, first_id, copies FROM r WHERE chunk_id <> first_id",
    "export_sources": f"WITH {CHUNKS_SQL} SELECT coalesce(source, '(no source)') AS src, count(*) AS chunks, count(*) FILTER (\"order\" IS NULL) AS without_order FROM c GROUP BY ALL",
    "bm25_topk": f"""WITH {CHUNKS_SQL}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS_SQL.format("question")})) AS term FROM eval_items), l AS (SELECT chunk_id, {TERMS_SQL.format("text")} AS w FROM c),
st AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM l), p AS (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM l), tf AS (SELECT term, chunk_id, len, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3""",
    "doc_scores": SCORES_SQL + " SELECT path, CAST(score AS BIGINT) AS score, penalty FROM sc",
    "corpus_report": SCORES_SQL + f""", c AS (SELECT coalesce(sum(CASE WHEN coalesce(path, '') IN ('', '(corpus)') AND NOT ("check" LIKE 'version-conflict%' AND len(coalesce(related, [])) > 0) THEN floor(least({WEIGHT_SQL}, {CAP_SQL}) / 2) ELSE 0 END), 0) AS k, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info FROM f),
m AS (SELECT greatest(0, CAST(round_even(avg(score), 0) AS BIGINT) - any_value(k)) AS raw, count(*) AS documents, any_value(n_error) AS n_error, any_value(n_warn) AS n_warn, any_value(n_info) AS n_info FROM sc, c)
SELECT CAST(CASE WHEN n_error > 0 THEN least(raw, 59) WHEN n_warn > 0 THEN least(raw, 89) ELSE raw END AS BIGINT) AS score, CASE WHEN n_error > 0 THEN 'NOT READY' WHEN n_warn > 0 THEN 'REVIEW' ELSE 'READY' END AS verdict, documents, n_error, n_warn, n_info FROM m""",
    "severity_counts": f"WITH {FIND_SQL} SELECT count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info FROM f",
    "category_counts": f"WITH {FIND_SQL} SELECT {CATEGORY_SQL} AS category, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info FROM f GROUP BY ALL",
    "taxonomy": f"SELECT * FROM (VALUES {_MODES_VALUES}) AS t(code, stage, name, grade, covered)",
    "mode_counts": f"WITH {FIND_SQL}, n AS (SELECT code, count(*) AS findings FROM (SELECT unnest(f_codes) AS code FROM f) GROUP BY code) SELECT code, stage, name, grade, covered, coalesce(findings, 0) AS findings FROM (VALUES {_MODES_VALUES}) AS t(code, stage, name, grade, covered) LEFT JOIN n USING (code)",
    "top_findings": f"WITH {FIND_SQL} SELECT finding_id, \"check\", severity, path, {TAG_SQL} AS tag FROM f WHERE severity <> 'info' ORDER BY {RANK_SQL}, {IMPACT_SQL}, \"check\", path, finding_id LIMIT 20",
    "graph_edges": f"""WITH {FIND_SQL}, e AS (SELECT path AS x, unnest(related) AS y, CASE "check" WHEN 'version-conflict' THEN 'conflict' WHEN 'version-stale' THEN 'stale' WHEN 'duplicate' THEN 'dup' END AS kind FROM f),
ch AS (SELECT list_append(related, path) AS c FROM f WHERE "check" = 'version-period-twins'), l AS (SELECT c, unnest(range(1, len(c))) AS i FROM ch), a AS (SELECT x, y, kind FROM e WHERE kind IS NOT NULL UNION ALL SELECT c[i], c[i + 1], 'period' FROM l)
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, kind FROM a WHERE x <> y""",
    "graph_nodes": f"""WITH {FIND_SQL}, {DOCS_SQL}, t AS (SELECT severity, unnest(CASE WHEN "check" IN ('version-conflict', 'duplicate') THEN list_prepend(path, related) ELSE [path] END) AS path FROM f),
n AS (SELECT path, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info FROM t GROUP BY path)
SELECT d.path, CASE WHEN read_error IS NOT NULL THEN 'unreadable' WHEN n_error > 0 THEN 'error' WHEN n_warn > 0 THEN 'warn' WHEN n_info > 0 THEN 'info' ELSE 'clean' END AS status, coalesce(n_error, 0) AS n_error, coalesce(n_warn, 0) AS n_warn, coalesce(n_info, 0) AS n_info FROM d LEFT JOIN n USING (path)""",
    "report_lines": f"""WITH {FIND_SQL} SELECT finding_id, {TAG_SQL} AS tag, replace(path || CASE WHEN location <> '' THEN ' ' || location ELSE '' END || CASE WHEN "check" IN ('version-conflict', 'version-stale', 'duplicate') AND len(related) > 0 THEN '  ↔  ' || array_to_string(related[1:2], ', ') ELSE '' END, '|', '\\|') AS line FROM f WHERE severity <> 'info'""",
    "duplicate_findings": "SELECT 'duplicate' AS \"check\", 'warn' AS severity, 'Exact duplicate of ' || first_path AS title, path FROM (" + TEXT_ORACLE["exact_duplicates"] + ")",
}
