"""Queries over texts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import chunking, dedup, extraction, metadata, personal
from sieveworks.sources import tables
from sieveworks.storage import materialize

AS_OF_YEAR = 2026

W = T.WORD
SP = T.SPACE
NW = T.NORM_WORD.replace("'", "''")
PAGES_SQL = (
    "WITH pg AS (SELECT p.* EXCLUDE (loaded_at), f.path, f.fmt, f.read_error FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1) p JOIN kb_files f USING (file_id)) "
)


def q_word_stats(spark, d):
    n = T.norm_words("text")
    return tables.documents(spark, d).select(
        "doc_id", T.word_count("text").alias("n_words"), F.size(n).cast("long").alias("n_norm_words"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        F.size(T.lines("text")).cast("long").alias("n_lines"),
    )


def q_unreadable(spark, d):
    docs = tables.documents(spark, d).select("path", "read_error").unionByName(tables.table(spark, d, "kb_files").select("path", "read_error"))
    bad = docs.filter("read_error is not null")
    return bad.select("path", F.lit("unreadable").alias("check"), F.lit("error").alias("severity"), F.concat(F.lit("Could not read: "), "read_error").alias("title"))


def q_exact_duplicates(spark, d):
    return dedup.exact_duplicates(tables.readable(tables.documents(spark, d)))


def q_duplicate_groups(spark, d):
    return dedup.exact_duplicates(tables.readable(tables.documents(spark, d))).groupBy("first_path").agg(F.max("group_size").alias("group_size"))


def q_near_pairs(spark, d):
    return dedup.near_pairs(tables.readable(tables.documents(spark, d))).select("path_a", "path_b", F.round("jaccard", 6).alias("jaccard"))


def q_lsh_pairs(spark, d):
    return dedup.lsh_pairs(tables.readable(tables.documents(spark, d)))


def q_components(spark, d):
    return dedup.components(dedup.near_pairs(tables.readable(tables.documents(spark, d))))


NORM_SQL = f"SELECT path, regexp_extract_all(lower(coalesce(text, '')), '{NW}') AS w FROM documents WHERE read_error IS NULL"
REPS_SQL = f"n AS ({NORM_SQL}), k AS (SELECT path, w, sha1(array_to_string(w, ' ')) AS h FROM n), reps AS (SELECT min(path) AS path, any_value(w) AS w FROM k WHERE len(w) >= 20 GROUP BY h)"
SH_SQL = "sh AS (SELECT path, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) AS s FROM reps)"
NEAR_SQL = f"""WITH {REPS_SQL}, {SH_SQL}, sz AS (SELECT path, count(*) AS n FROM sh GROUP BY path),
c AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.path < b.path GROUP BY ALL),
near AS (SELECT path_a, path_b, i / (x.n + y.n - i) AS jaccard FROM c JOIN sz x ON x.path = path_a JOIN sz y ON y.path = path_b WHERE i / (x.n + y.n - i) >= 0.5)"""


def _email_sql(table: str, key: str) -> str:
    roles = ", ".join(f"'{r}'" for r in personal.ROLE_MAILBOXES)
    ends = "|".join(x.replace(".", r"\.") for x in personal.EXAMPLE_DOMAINS)
    return f"""SELECT DISTINCT {key}, v AS email FROM (SELECT {key}, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) AS v FROM {table})
WHERE lower(split_part(v, '@', 1)) NOT IN ({roles}) AND NOT regexp_matches(lower(v), '(?:{ends})$')"""


def _chunk_hits(spark, d):
    c = tables.chunks(spark, d).select(F.col("chunk_id").cast("string").alias("path"), F.lit("chunks").alias("fmt"), F.lit(1).alias("page"), F.lit(0).alias("line_offset"), "text")
    return personal.hits(c)


def _page_hits(spark, d):
    p = tables.pages(spark, d).select("path", "fmt", F.col("number").alias("page"), "line_offset", "text")
    return personal.hits(p)


def q_pii_email(spark, d):
    return _page_hits(spark, d).filter("kind = 'email address'").select("path", F.col("value").alias("email")).distinct()


def q_pii_ssn(spark, d):
    return _chunk_hits(spark, d).filter("kind = 'US SSN'").select(F.col("path").cast("long").alias("chunk_id"), F.col("value").alias("ssn")).distinct()


def q_pii_card(spark, d):
    return _page_hits(spark, d).filter("kind = 'payment card number'").select("path", F.col("value").alias("card")).distinct()


def q_pii_phone(spark, d):
    return _page_hits(spark, d).filter("kind = 'phone number'").select("path", F.col("value").alias("phone")).distinct()


def q_secrets(spark, d):
    return _chunk_hits(spark, d).filter(F.col("kind").isin(list(personal.SECRETS))).select(F.col("path").alias("chunk_id"), "kind", personal.mask_value(F.col("kind"), F.col("value")).alias("masked"))


def q_pii_findings(spark, d):
    f = personal.findings(_page_hits(spark, d))
    return f.select("check", "severity", F.array_join("f_codes", ",").alias("codes"), "title", "path", "location")


def q_pii_masked(spark, d):
    return _page_hits(spark, d).filter("kind = 'email address'").select("path", T.masked("value").alias("masked")).distinct()


def q_pii_redacted(spark, d):
    c = tables.chunks(spark, d).select("chunk_id", "text", personal.redact("text").alias("redacted"))
    return c.filter("redacted <> text").select("chunk_id", "redacted")


def q_garbled_counts(spark, d):
    p = extraction.garbled_counts(tables.pages(spark, d).filter("text is not null"))
    return p.select("page_id", "n_chars", "n_replacement", "n_cid", "n_mojibake")


def q_garbled_signals(spark, d):
    p = extraction.garbled_counts(tables.pages(spark, d).filter("text is not null"))
    return p.filter(F.size("signals") > 0).select("page_id", F.array_join("signals", ", ").alias("signals"), "n_control", "n_spaced", "n_junk", "n_ascii", "n_stop")


def q_page_stats(spark, d):
    return extraction.page_stats(tables.pages(spark, d))


def q_scanned_pages(spark, d):
    s = extraction.page_stats(tables.pages(spark, d)).filter("fmt = 'pdf' and images >= 1 and chars < 25")
    return s.groupBy("path").agg(F.count(F.lit(1)).alias("n"), extraction.page_ranges(F.collect_list("number")).alias("at"))


def q_image_pages(spark, d):
    s = extraction.page_stats(tables.pages(spark, d)).filter("fmt = 'pdf' and images >= 3 and words < 80 and not (images >= 1 and chars < 25)")
    return s.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("images").cast("long").alias("images"))


def q_page_ranges(spark, d):
    p = tables.pages(spark, d).filter(T.word_count("text") < 60)
    return p.groupBy("path").agg(extraction.page_ranges(F.collect_list("number")).alias("at"))


def q_extraction_findings(spark, d):
    f = extraction.findings(tables.pages(spark, d).filter("read_error is null"))
    return f.select("check", "severity", F.array_join("f_codes", ",").alias("codes"), "title", "path", "location")


def q_table_rows(spark, d):
    return extraction.table_lines(tables.documents(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.count_if("is_row").alias("n_rows"), F.count(F.lit(1)).alias("n_lines"))


def q_table_runs(spark, d):
    return extraction.table_runs(tables.documents(spark, d), ["doc_id"]).select("doc_id", "first_line", "last_line", "n_rows")


def q_number_tokens(spark, d):
    toks = T.words("text")
    return tables.documents(spark, d).select("doc_id", F.size(toks).cast("long").alias("n"), F.size(F.filter(toks, T.is_number_token)).cast("long").alias("numbers"))


NUM_SQL = r"(?i)^(?:[(\[]?[-+−±~<>≈]?[$€£¥]?[0-9][0-9,.:/]*(?:%|[kmb]n?|x)?[)\]]?[,;]?|[-–—]|n/?a)$"
ROW_SQL = f"""ln AS (SELECT doc_id, fmt <> 'md' AS pipes, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
st AS (SELECT doc_id, pipes, line, regexp_replace(s, '^[{SP}]+|[{SP}]+$', '', 'g') AS raw FROM ln),
nb AS (SELECT *, regexp_replace(raw, '^(?:[-*•▪◦]|[0-9]{{1,2}}[.)])[{SP}]+', '') AS s FROM st WHERE raw <> ''),
tk AS (SELECT *, regexp_extract_all(s, '{W}') AS toks, list_filter(regexp_split_to_array(s, '\\t+| {{2,}}'), lambda x: x <> '') AS gaps, string_split(regexp_replace(s, '^\\|+|\\|+$', '', 'g'), '|') AS cells FROM nb),
rw AS (SELECT *, len(list_filter(toks, lambda x: regexp_matches(x, '{NUM_SQL}'))) AS nums FROM tk),
isr AS (SELECT doc_id, line, length(raw) <= 400 AND regexp_matches(raw, '[|0-9]') AND (
 (pipes AND contains(s, '|') AND NOT contains(s, '||') AND len(cells) >= 2 AND len(list_filter(cells, lambda x: regexp_replace(x, '^[{SP}]+|[{SP}]+$', '', 'g') <> '')) > 0)
 OR (regexp_matches(s, '\\t|  ') AND len(gaps) >= 3 AND len(list_filter(gaps, lambda x: regexp_matches(regexp_replace(x, '^[{SP}]+|[{SP}]+$', '', 'g'), '{NUM_SQL}'))) > 0)
 OR (len(toks) >= 3 AND nums >= 2 AND nums / len(toks) >= 0.5)) AS is_row FROM rw)"""


def q_headings(spark, d):
    docs = tables.documents(spark, d).select("doc_id", "fmt", F.explode(T.lines("text")).alias("s"))
    return docs.filter(T.is_heading("s", F.col("fmt").isin("md", "txt"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_headings"))


def q_rule_density(spark, d):
    return tables.documents(spark, d).filter("text is not null").select("doc_id", F.round(T.rule_density("text"), 6).alias("density"))


def q_word_windows(spark, d):
    w = chunking.word_windows(tables.documents(spark, d), "doc_id", 120, 20)
    return w.select("doc_id", "chunk_no", "first_word", "n_words", F.md5("chunk").alias("digest"))


def q_recursive_chunks(spark, d):
    return chunking.recursive_chunks(tables.documents(spark, d), "doc_id", 1000, 200).select("doc_id", "chunk_no", "start", "end", F.md5("chunk").alias("digest"))


#: a public vocabulary for token windows; a parameter of the splitter
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def q_token_windows(spark, d):
    c = chunking.chunked(tables.documents(spark, d), "doc_id", "tokens:256:32", VOCABULARY)
    return c.select("doc_id", "chunk_no", "start", "end", F.md5("chunk").alias("digest"))


def q_cut_sentences(spark, d):
    ends = chunking.boundaries(tables.documents(spark, d), "doc_id", "langchain:1000:200")
    return chunking.cut_sentences(ends).select("doc_id", "chunk_no", "line", "qualifier")


def q_orphan_headings(spark, d):
    docs = tables.documents(spark, d)
    return chunking.orphan_headings(chunking.boundaries(docs, "path", "langchain:1000:200"), docs)


def q_split_tables(spark, d):
    docs = tables.documents(spark, d)
    return chunking.split_tables(materialize(chunking.boundaries(docs, "path", "langchain:1000:200").select("path", "chunk_no", "end"), "boundaries"), docs)


def q_chunk_findings(spark, d):
    f = chunking.findings(tables.readable(tables.documents(spark, d)), "langchain:1000:200")
    return f.select("check", "severity", "title", "path", "location")


def q_metadata_flags(spark, d):
    return metadata.flags(tables.readable(tables.documents(spark, d))).select("path", F.col("year").cast("long").alias("year"), "has_owner", "placeholders")


def q_metadata_findings(spark, d):
    f = metadata.findings(tables.readable(tables.documents(spark, d)), AS_OF_YEAR)
    return f.select("check", "severity", "title", "path")


PH = metadata.PLACEHOLDER
DATE_SQL = r"(?i)\b(?:effective|updated|last updated|revised|reviewed|as of|dated)\b[^\n]{0,20}?((?:19|20)[0-9]{2})"
FLAGS_SQL = f"""WITH m AS (SELECT path, text, coalesce(metadata['date'], '') AS d, coalesce(metadata['author'], '') AS a, coalesce(metadata['owner'], '') AS o, coalesce(metadata['title'], '') AS t FROM documents WHERE read_error IS NULL),
f AS (SELECT path, CAST(coalesce(nullif(regexp_extract(d, '((?:19|20)[0-9]{{2}})', 1), ''), nullif(regexp_extract(left(text, 4000), '{DATE_SQL}', 1), '')) AS BIGINT) AS year,
 (trim(a) <> '' AND NOT regexp_matches(trim(a), '{PH}')) OR (trim(o) <> '' AND NOT regexp_matches(trim(o), '{PH}')) AS has_owner,
 array_to_string(list_filter([CASE WHEN t <> '' AND regexp_matches(trim(t), '{PH}') THEN 'title="' || t || '"' END, CASE WHEN a <> '' AND regexp_matches(trim(a), '{PH}') THEN 'author="' || a || '"' END], lambda x: x IS NOT NULL), ', ') AS placeholders FROM m)"""

RANGES = "'p.' || array_to_string([CASE WHEN x.a = x.b THEN x.a::VARCHAR ELSE x.a || '–' || x.b END for x in runs[1:8]], ', ') || CASE WHEN len(runs) > 8 THEN ' (+' || (len(runs) - 8) || ' more ranges)' ELSE '' END"


def _ranges_sql(condition: str, extra: str = "") -> str:
    return PAGES_SQL + f""", hit AS (SELECT DISTINCT path, number FROM pg WHERE {condition}), g AS (SELECT path, number, number - row_number() OVER (PARTITION BY path ORDER BY number) AS k FROM hit),
r AS (SELECT path, min(number) AS a, max(number) AS b FROM g GROUP BY path, k), l AS (SELECT path, list({{'a': a, 'b': b}} ORDER BY a) AS runs FROM r GROUP BY path)
SELECT path, {extra}{RANGES} AS at FROM l"""


WORDS_PG = f"len(regexp_extract_all(coalesce(text, ''), '{W}'))"
CHARS_PG = f"coalesce(length(regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g')), 0)"
IMG_PG = "greatest(coalesce(image_count, 0), 0)"
SCAN = f"fmt = 'pdf' AND {IMG_PG} >= 1 AND {CHARS_PG} < 25"

QUERIES = {
    "word_stats": q_word_stats, "unreadable": q_unreadable, "exact_duplicates": q_exact_duplicates, "duplicate_groups": q_duplicate_groups, "near_pairs": q_near_pairs, "lsh_pairs": q_lsh_pairs, "near_components": q_components,
    "pii_email": q_pii_email, "pii_ssn": q_pii_ssn, "pii_card": q_pii_card, "pii_phone": q_pii_phone, "secrets": q_secrets, "pii_findings": q_pii_findings, "pii_masked": q_pii_masked, "pii_redacted": q_pii_redacted,
    "garbled_counts": q_garbled_counts, "garbled_signals": q_garbled_signals, "page_stats": q_page_stats, "scanned_pages": q_scanned_pages, "image_pages": q_image_pages, "page_ranges": q_page_ranges, "extraction_findings": q_extraction_findings,
    "table_rows": q_table_rows, "table_runs": q_table_runs, "number_tokens": q_number_tokens, "headings": q_headings, "rule_density": q_rule_density, "word_windows": q_word_windows, "recursive_chunks": q_recursive_chunks, "token_windows": q_token_windows,
    "cut_sentences": q_cut_sentences, "orphan_headings": q_orphan_headings, "split_tables": q_split_tables, "chunk_findings": q_chunk_findings, "metadata_flags": q_metadata_flags, "metadata_findings": q_metadata_findings,
}

ORACLE = {
    "word_stats": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS n_words, len(regexp_extract_all(lower(coalesce(text, '')), '{NW}')) AS n_norm_words, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents",
    "unreadable": "SELECT path, 'unreadable' AS \"check\", 'error' AS severity, 'Could not read: ' || read_error AS title FROM (SELECT path, read_error FROM documents UNION ALL SELECT path, read_error FROM kb_files) WHERE read_error IS NOT NULL",
    "exact_duplicates": f"WITH n AS ({NORM_SQL}), k AS (SELECT path, sha1(array_to_string(w, ' ')) AS h FROM n WHERE len(w) >= 10), g AS (SELECT h, min(path) AS first_path, count(*) AS group_size FROM k GROUP BY h HAVING count(*) > 1) SELECT path, first_path, group_size FROM k JOIN g USING (h) WHERE path <> first_path",
    "duplicate_groups": f"WITH n AS ({NORM_SQL}), k AS (SELECT path, sha1(array_to_string(w, ' ')) AS h FROM n WHERE len(w) >= 10) SELECT min(path) AS first_path, count(*) AS group_size FROM k GROUP BY h HAVING count(*) > 1",
    "near_pairs": NEAR_SQL + " SELECT path_a, path_b, round(jaccard, 6) AS jaccard FROM near",
    "lsh_pairs": f"""WITH {REPS_SQL}, {SH_SQL}, x AS (SELECT path, ('0x' || substr(md5(s), 1, 15))::BIGINT AS x FROM sh), m AS (SELECT path, x % 32 AS bin, min(x // 32) AS least FROM x GROUP BY ALL),
b AS (SELECT path, bin // 2 AS band, list(least ORDER BY bin) AS v FROM m GROUP BY ALL HAVING count(*) = 2), f AS (SELECT band, v FROM b GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50), kept AS (SELECT b.* FROM b JOIN f USING (band, v))
SELECT DISTINCT a.path AS path_a, b.path AS path_b FROM kept a JOIN kept b ON a.band = b.band AND a.v = b.v AND a.path < b.path""",
    "near_components": NEAR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", e AS (SELECT path_a AS u, path_b AS v FROM near UNION SELECT path_b, path_a FROM near), r AS (SELECT DISTINCT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node) SELECT node, min(c) AS component FROM r GROUP BY node",
    "pii_email": PAGES_SQL + _email_sql("pg", "path"),
    "pii_masked": PAGES_SQL + "SELECT DISTINCT path, left(email, 1) || '***@' || split_part(email, '@', 2) AS masked FROM (" + _email_sql("pg", "path") + ")",
    "pii_ssn": "SELECT DISTINCT chunk_id, v AS ssn FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b')) AS v FROM chunks) WHERE left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND substr(v, 5, 2) <> '00' AND right(v, 4) <> '0000'",
    "garbled_counts": PAGES_SQL + "SELECT page_id, length(text) AS n_chars, length(text) - length(replace(text, '�', '')) AS n_replacement, len(regexp_extract_all(text, '\\(cid:[0-9]+\\)')) AS n_cid, len(regexp_extract_all(text, '" + extraction.MOJIBAKE + "')) AS n_mojibake FROM pg WHERE text IS NOT NULL",
    "page_stats": PAGES_SQL + f"SELECT path, fmt, number, {WORDS_PG} AS words, {CHARS_PG} AS chars, {IMG_PG} AS images FROM pg",
    "scanned_pages": _ranges_sql(SCAN, "(SELECT count(*) FROM hit h WHERE h.path = l.path) AS n, "),
    "image_pages": PAGES_SQL + f"SELECT path, count(*) AS n, CAST(sum({IMG_PG}) AS BIGINT) AS images FROM pg WHERE fmt = 'pdf' AND {IMG_PG} >= 3 AND {WORDS_PG} < 80 AND NOT ({IMG_PG} >= 1 AND {CHARS_PG} < 25) GROUP BY path",
    "page_ranges": _ranges_sql(f"{WORDS_PG} < 60"),
    "table_rows": f"WITH {ROW_SQL} SELECT doc_id, count(*) FILTER (is_row) AS n_rows, count(*) AS n_lines FROM isr GROUP BY doc_id",
    "table_runs": f"WITH {ROW_SQL}, g AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM isr) SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n_rows FROM g WHERE is_row GROUP BY doc_id, k HAVING count(*) >= 4",
    "number_tokens": f"SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '{NUM_SQL}'))) AS numbers FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents)",
    "headings": f"""WITH ln AS (SELECT doc_id, fmt IN ('md', 'txt') AS md, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^[{SP}]+|[{SP}]+$', '', 'g') AS s FROM documents),
x AS (SELECT *, len(regexp_extract_all(s, '{W}')) AS n, regexp_replace(s, '[^\\p{{L}}]', '', 'g') AS letters FROM ln WHERE s <> '' AND length(s) <= 120)
SELECT doc_id, count(*) AS n_headings FROM x WHERE CASE WHEN s LIKE '#%' THEN md AND regexp_matches(s, '{T.HEADING_MD}') ELSE n <= 12 AND NOT regexp_matches(s, '[.,;:?!]$') AND NOT contains(s, '|') AND ((regexp_matches(s, '{T.HEADING_NUMBER}') AND n >= 2)
 OR (n BETWEEN 2 AND 8 AND length(letters) >= 6 AND regexp_replace(letters, '\\p{{Lu}}', '', 'g') = '' AND len(regexp_extract_all(s, '[0-9]')) <= 2)) END GROUP BY doc_id""",
    "rule_density": f"SELECT doc_id, round(1000 * len(regexp_extract_all(lower(text), '\\b(?:{T.RULE_WORDS})\\b')) / greatest(len(regexp_extract_all(text, '{W}')), 1), 6) AS density FROM documents WHERE text IS NOT NULL",
    "word_windows": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS chunk_no, start AS first_word, least(120, len(w) - start) AS n_words, md5(array_to_string(w[start + 1:start + 120], ' ')) AS digest FROM s WHERE start = 0 OR start < len(w) - 20""",
    "metadata_flags": FLAGS_SQL + " SELECT path, year, has_owner, placeholders FROM f",
    "metadata_findings": FLAGS_SQL + f""", c AS (SELECT count(*) AS n, count(*) FILTER (year IS NULL) AS d, count(*) FILTER (NOT has_owner) AS o FROM f)
SELECT 'metadata-no-date' AS "check", 'warn' AS severity, d || ' of ' || n || ' documents have no date' AS title, '(corpus)' AS path FROM c
UNION ALL SELECT 'metadata-no-owner', 'warn', o || ' of ' || n || ' documents have no owner or author', '(corpus)' FROM c
UNION ALL SELECT 'metadata-placeholder', 'info', 'Placeholder metadata: ' || placeholders, path FROM f WHERE placeholders <> ''
UNION ALL SELECT 'metadata-old', 'info', 'Last dated ' || year || ' (' || ({AS_OF_YEAR} - year) || ' years ago)', path FROM f WHERE {AS_OF_YEAR} - year > 3""",
}
