"""SQL for the operators whose results SQL can state. Words are runs of letters and digits in lower case, accents composed."""

from __future__ import annotations

_W = r"[\p{L}\p{N}]+"
_LINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]"
_FIELD = r"^[^\p{L}\p{N}_:]*[\p{L}\p{N}][^:]*:[\s\x{a0}]+.*[\p{L}\p{N}].*$"


def _records(*tables: tuple[str, str]) -> str:
    """Words and canonical text of each record: k, id, w, canon."""
    union = " UNION ALL ".join(f"SELECT '{name}' AS k, {key} AS id, lower(nfc_normalize(text)) AS t FROM {name} WHERE text IS NOT NULL" for name, key in tables)
    return f"""raw AS ({union}), ln AS (SELECT k, id, t, regexp_extract_all(t, '{_W}') AS w, regexp_split_to_array(t, '{_LINES}') AS lines FROM raw),
hd AS (SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches(l, '{_FIELD}')), false), len(lines) + 1) - 1 AS n FROM ln),
rec AS (SELECT DISTINCT k, id, w, CASE WHEN n >= 2 THEN array_to_string(list_sort(list_transform(lines[1:n], lambda l: array_to_string(regexp_extract_all(l, '{_W}'), ' '))), chr(10)) || chr(10)
 || array_to_string(regexp_extract_all(array_to_string(lines[n + 1:], chr(10)), '{_W}'), ' ') ELSE array_to_string(w, ' ') END AS canon FROM hd)"""


_COPIES = f"WITH {_records(('documents', 'doc_id'), ('chunks', 'chunk_id'))}, g AS (SELECT DISTINCT k, id, canon FROM rec WHERE len(w) >= 10)"
_NEAR = f"""WITH {_records(('documents', 'doc_id'), ('pages', 'page_id'))}, nd AS (SELECT k, array_to_string(w, ' ') AS words, any_value(w) AS w, min(id) AS rep FROM rec WHERE len(w) >= 20 GROUP BY ALL),
sh AS (SELECT k, rep, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM nd), sz AS (SELECT k, rep, count(*) AS n FROM sh GROUP BY ALL),
co AS (SELECT a.k, a.rep AS a, b.rep AS b, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.s = b.s AND a.rep < b.rep GROUP BY ALL),
near AS (SELECT co.k, a, b, i / (x.n + y.n - i) AS similarity FROM co JOIN sz x ON x.k = co.k AND x.rep = a JOIN sz y ON y.k = co.k AND y.rep = b WHERE 2 * i >= x.n + y.n - i),
mem AS (SELECT DISTINCT rec.k, rec.id, rec.canon, nd.rep FROM rec JOIN nd ON nd.k = rec.k AND nd.words = array_to_string(rec.w, ' '))"""

ORACLE = {
    "p1_found": _COPIES + ", m AS (SELECT k, canon, min(id) AS id_a FROM g GROUP BY ALL HAVING count(*) > 1) SELECT g.k AS record_kind, id_a, g.id AS id_b FROM g JOIN m ON g.k = m.k AND g.canon = m.canon WHERE g.id <> id_a",
    "p1_collapsed": _COPIES + " SELECT k AS record_kind, min(id) AS id, count(DISTINCT g.id) AS copies FROM g GROUP BY k, canon",
    "p4_found": _NEAR + " SELECT DISTINCT near.k AS record_kind, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM near JOIN mem x ON x.k = near.k AND x.rep = near.a JOIN mem y ON y.k = near.k AND y.rep = near.b WHERE x.canon <> y.canon AND x.id <> y.id",
    "p4_pairs": _NEAR + " SELECT k AS record_kind, a AS id_a, b AS id_b, similarity FROM near",
    "p4_members": _NEAR + " SELECT DISTINCT mem.k AS record_kind, id, rep AS rep_id FROM mem JOIN (SELECT k, a AS rep FROM near UNION SELECT k, b FROM near) USING (k, rep)",
    "p5_found": "SELECT 'documents' AS record_kind, doc_id AS record_id FROM documents WHERE length(text) > 4000 UNION SELECT 'chunks', chunk_id FROM chunks WHERE length(text) > 2000",
    "p7_found": f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '{_W}') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '{_W}') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d), ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
