"""SQL counterparts of hard negatives and of periodic runs."""

from __future__ import annotations

NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
               AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""

# Equal stretches of 2^k words next to each other at a distance d with 2^(k-1) < d <= 2^k mark runs of period d.
RUNS_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS sid,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), c AS (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(sid) + 1),
           lambda i: [CAST(ascii(sid[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS h
  FROM d
), a AS (
  SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN h // 10 % n END AS a, h // 10 AS g FROM c
), w AS (
  SELECT rid, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM a)
), grams AS (
  SELECT 0 AS k, rid, i, hash(w) AS h FROM w
  UNION ALL
  SELECT x.k + 1, x.rid, x.i, hash(x.h, y.h) FROM grams x JOIN grams y ON x.rid = y.rid AND y.i = x.i + (1 << x.k)
), near AS (
  SELECT k, rid, i, lead(i) OVER (PARTITION BY k, rid, h ORDER BY i) - i AS d FROM grams
), runs AS (
  SELECT rid, min(i) AS start, max(i) + d + (1 << k) - min(i) AS length, d AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY k, rid, d ORDER BY i) AS island FROM near
        WHERE d <= 1 << k AND 2 * d > 1 << k)
  GROUP BY k, rid, d, island
  HAVING max(i) + d + (1 << k) - min(i) >= greatest(6, 4 * d)
), best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
  FROM runs GROUP BY rid
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM w
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.rid = w.rid AND i >= start + period AND i < start + length) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""
