"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations


def _assigned(name: str, book: str) -> str:
    """Every part with the nearest entry of a codebook, the lower entry on ties."""
    return f"""
{name} AS (
  SELECT vec_id, label, part, a, b, c, d, entry, far FROM (
    SELECT p.*, k.entry, (p.a - k.a) * (p.a - k.a) + (p.b - k.b) * (p.b - k.b)
        + (p.c - k.c) * (p.c - k.c) + (p.d - k.d) * (p.d - k.d) AS far,
      row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY (p.a - k.a) * (p.a - k.a) + (p.b - k.b) * (p.b - k.b)
        + (p.c - k.c) * (p.c - k.c) + (p.d - k.d) * (p.d - k.d), k.entry) AS place
    FROM p JOIN {book} k ON p.part = k.part) WHERE place = 1)"""


def _moved(name: str, assigned: str, book: str) -> str:
    """The codebook with every entry that has parts at their mean."""
    means = ", ".join(f"CAST(floor(sum({x}) / count(*)) AS BIGINT) AS {x}" for x in "abcd")
    taken = ", ".join(f"coalesce(m.{x}, k.{x}) AS {x}" for x in "abcd")
    return f"""
{name} AS (
  SELECT k.part, k.entry, {taken} FROM {book} k
  LEFT JOIN (SELECT part, entry, {means} FROM {assigned} GROUP BY part, entry) m
  ON k.part = m.part AND k.entry = m.entry)"""


PRODUCT_CODES = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (
  SELECT vec_id, label, t.part, x[4 * t.part + 1] AS a, x[4 * t.part + 2] AS b, x[4 * t.part + 3] AS c,
    x[4 * t.part + 4] AS d FROM v CROSS JOIN (SELECT unnest(range(16)) AS part) t),
k0 AS (
  SELECT part, entry, a, b, c, d FROM (
    SELECT p.*, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),
{_assigned("n1", "k0")}, {_moved("k1", "n1", "k0")},
{_assigned("n2", "k1")}, {_moved("k2", "n2", "k1")},
{_assigned("n3", "k2")},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    CAST(sum(far) AS BIGINT) AS error FROM n3 GROUP BY vec_id, label),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label),
book AS (
  SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM k2)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN totals ON coded.label IS NOT DISTINCT FROM totals.label CROSS JOIN book
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda s: s <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])) END) AS g
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (
  SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common
  FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_have JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS goal FROM w
  UNION SELECT r.doc_id, y.b FROM reached r JOIN ways y ON r.goal = y.a)
SELECT w.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.goal) AS component_id,
  w.doc_id = min(r.goal) AS kept
FROM w JOIN reached r ON w.doc_id = r.doc_id LEFT JOIN sizes z ON w.doc_id = z.doc_id GROUP BY w.doc_id
"""
