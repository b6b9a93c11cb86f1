"""DuckDB SQL of operators whose whole result it can express, written from their contracts."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links on full shingle sets, components by walking the links.
NEAR_DUPLICATES = rf"""WITH RECURSIVE cut AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (SELECT row, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingles FROM cut),
each AS (SELECT row, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.row AS a, b.row AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.row <> b.row GROUP BY a.row, b.row),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
reach AS (SELECT row, row AS other FROM sets UNION SELECT r.row, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT r.row, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.row = r.other GROUP BY r.row)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (row)"""

#: Windows by the digest of their words; words come one by one, without those that a window covers.
REPEATS = rf"""WITH cut AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT row, doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS key FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM cut WHERE len(ws) >= 50)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
covered AS (SELECT DISTINCT row, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (key) WHERE first < doc_id),
words AS (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM cut),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (row, p) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (row)"""
