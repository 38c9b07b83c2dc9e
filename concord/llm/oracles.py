"""DuckDB SQL of the operators that SQL can express on whole tables, by their definitions alone."""

from __future__ import annotations

#: Every pair of sets that share a shingle, sets that are equal once; links, their components and counts.
NGRAM_JACCARD = r"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
sets AS (
    SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))) END AS shingles
    FROM texts),
rows_of AS (SELECT r, doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS class, shingles FROM sets),
classes AS (SELECT class, any_value(n) AS n, any_value(shingles) AS shingles, count(*) AS copies, min(doc_id) AS least FROM rows_of WHERE n > 0 GROUP BY class),
entries AS (SELECT class, n, unnest(shingles) AS shingle FROM classes),
links AS (
    SELECT a.class AS a, b.class AS b
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.class <> b.class AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.class, b.class, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
    SELECT class AS a, class AS b FROM classes
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
heads AS (SELECT a AS class, min(least) AS head FROM reached JOIN classes ON b = class GROUP BY a),
others AS (SELECT a AS class, sum(copies) AS n FROM links JOIN classes ON b = class GROUP BY a)
SELECT doc_id, rows_of.n AS n_shingles, coalesce(head, doc_id) AS component_id, CAST(coalesce(copies - 1, 0) + coalesce(others.n, 0) AS BIGINT) AS n_links
FROM rows_of LEFT JOIN classes ON rows_of.class = classes.class AND rows_of.n > 0
LEFT JOIN heads ON classes.class = heads.class LEFT JOIN others ON classes.class = others.class
"""

#: Windows that begin more than once, the places they cover and the words beside them.
SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts),
windows AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM starts),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
covered AS (SELECT r, list(DISTINCT i + o) AS places FROM again, range(35) AS t(o) GROUP BY r),
each AS (SELECT r, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM texts),
kept AS (
    SELECT each.r, string_agg(word, ' ' ORDER BY each.j) AS words, count(*) AS n
    FROM each LEFT JOIN (SELECT r, unnest(places) AS j FROM covered) AS c ON each.r = c.r AND each.j = c.j
    WHERE c.j IS NULL GROUP BY each.r)
SELECT doc_id, CAST(len(texts.words) AS BIGINT) AS n_words, CAST(len(texts.words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM texts LEFT JOIN kept ON texts.r = kept.r
"""

#: Every pair of vectors of one length.
NEAR_VECTORS = r"""
WITH RECURSIVE whole AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
checked AS (
    SELECT r, vec_id, list_transform(v, lambda x: coalesce(x, 0)) AS v,
           len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 AS ok FROM whole),
sound AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM checked WHERE ok),
links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id
    FROM sound a JOIN sound b ON len(a.v) = len(b.v) AND a.r <> b.r
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95 END),
reached AS (
    SELECT r AS a, r AS b FROM whole
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
heads AS (SELECT a AS r, min(vec_id) AS head FROM reached JOIN whole ON b = r GROUP BY a),
degrees AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, head AS component_id, vec_id = head AS kept
FROM whole JOIN heads ON whole.r = heads.r LEFT JOIN degrees ON whole.r = degrees.r
"""
