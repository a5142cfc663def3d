"""SQL of the queries that another engine can express, written from the contracts alone."""

from __future__ import annotations

from .license_join import PHRASES, TEMPLATES, THRESHOLD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED_WORD = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({column}, '')"
    if lower:
        text = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    return f"regexp_extract_all({text}, '{pattern}')"


def decontamination() -> str:
    return f"""
WITH doc AS (SELECT doc_id, {_words('text', _PLAIN_WORD, True)} AS w FROM documents),
item AS (SELECT item_id, {_words('text', _PLAIN_WORD, True)} AS w FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS key
    FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
place AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM pattern))
),
found AS (SELECT doc_id, i, size, item_id FROM place JOIN pattern USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def jaccard_join() -> str:
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words('text', _SPACED_WORD, True)} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s
    FROM doc
),
kinds AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
element AS (SELECT rep, n, unnest(s) AS e FROM kinds),
link AS (
    SELECT a.rep AS a, b.rep AS b FROM element a JOIN element b ON a.e = b.e AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS node, rep AS root FROM kinds UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node),
component AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN kinds USING (s) LEFT JOIN component ON node = rep"""


def quality_rules() -> str:
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, {_words('text', _SPACED_WORD, False)} AS w FROM documents),
line AS (
    SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS dup
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{_SPACED_WORD}') GROUP BY 1
),
win AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc)
),
twice AS (SELECT doc_id, key FROM win GROUP BY 1, 2 HAVING count(*) > 1),
again AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, key)) GROUP BY 1
),
measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(lines, 0) AS lines, (length(t) - length(replace(t, '!!', ''))) // 2 AS marks,
        len([x FOR x IN w IF regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')]) AS capitals,
        len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS stutters
    FROM doc LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 10 * marks > n_words OR 2 * capitals > n_words OR 10 * stutters > 3 * n_words
        OR NOT (word_chars BETWEEN 2 * n_words AND 100 * n_words) OR (lines >= 4 AND 2 * n_dup_lines > lines)) AS kept
FROM judged"""


def license_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = " UNION ALL ".join(f"SELECT {p.split()!r} AS phrase, {quoted(label)} AS label" for p, label in PHRASES.items())
    templates = " UNION ALL ".join(f"SELECT {n} AS template, {quoted(label)} AS label, {quoted(text)} AS text" for n, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH doc AS (SELECT doc_id, text, {_words('text', _PLAIN_WORD, True)} AS w FROM documents),
phrase AS ({phrases}),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc
    WHERE list_has_any(w, ['gnu', 'apache', 'cc', 'mit'])),
place AS (SELECT doc_id, i - 1 AS i, label FROM starts JOIN phrase ON w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY 1),
template AS (SELECT template, label, list_distinct({_words('text', _PLAIN_WORD, True)}) AS s FROM ({templates})),
block AS (
    SELECT doc_id, {_words('l', _PLAIN_WORD, True)} AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
),
met AS (
    SELECT doc_id, label, len(list_intersect(s, b)) / len(s) AS share FROM block JOIN template ON list_has_any(s, b)
    WHERE len(list_intersect(s, b)) >= ceil({THRESHOLD} * len(s) - 1e-9)
),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, array_to_string(coalesce(base.labels, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
    CASE WHEN base.labels IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


def pivot_search() -> str:
    return """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x) FOR x IN CAST(embedding AS DOUBLE[])] AS whole
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.whole, c.whole) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


def all_sql() -> dict[str, str]:
    return {"op5_license_scan": license_scan(), "op8_decontamination": decontamination(), "op9_jaccard_join": jaccard_join(),
            "op10_quality_rules": quality_rules(), "op13_pivot_search": pivot_search()}
