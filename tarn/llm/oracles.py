"""The same rows in plain SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM worded
), elements AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id
"""


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def licenses_sql() -> str:
    """Brute force: every stretch that begins at a template's word against that template."""
    starts = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"SELECT row, '{label}' AS label, i FROM (SELECT row, w, unnest(range(0, len(w) - {len(parts) - 1})) AS i FROM worded) WHERE {same}")
    entries = []
    for label, text in licenses.TEMPLATES:
        t = licenses.template_words(text)
        names = [w for w in t if w in licenses.NAMES]
        entries.append(f"SELECT '{label}' AS label, {_list(t)} AS t, {_list(names) if names else 'CAST([] AS VARCHAR[])'} AS names, {licenses.stretch_words(text, 0.8)} AS stretch")
    return rf"""
WITH worded AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), places AS (
    {" UNION ALL ".join(starts)}
), templates AS ({" UNION ALL ".join(entries)}
), words AS (
    SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM worded
), begins AS (
    SELECT DISTINCT row, i, label, t, names, stretch FROM words JOIN (SELECT *, unnest(t) AS y FROM templates) ON x = y
), held AS (
    SELECT label, t, names, row, list_distinct(w[i : i + stretch - 1]) AS s FROM begins JOIN worded USING (row)
), met AS (
    SELECT row, label, len(list_intersect(s, t)) AS common, len(t) AS size FROM held WHERE len(list_intersect(s, names)) = len(names)
), own AS (
    SELECT row, list(DISTINCT label) AS labels, max(common / CAST(size AS DOUBLE)) AS score FROM met WHERE common >= ceil(0.8 * size - 1e-9) GROUP BY row
), base AS (
    SELECT row, count(*) AS n, min(i) AS first, max(i) AS last, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
    coalesce(array_to_string(base.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
    CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM worded LEFT JOIN base USING (row) LEFT JOIN own USING (row)
"""
