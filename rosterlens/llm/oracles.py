"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS ws FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(ws) AS n FROM win),
runs AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS ws FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM runs JOIN win USING (ws)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE doc_id > lo),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT placed.doc_id, count(gone.p) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM placed LEFT JOIN gone USING (doc_id, p) GROUP BY placed.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor, x.id AS other, a.label = x.label AS same, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
  FROM v a JOIN v x ON a.id % 100 = 0 AND a.id <> x.id),
pos AS (
  SELECT anchor, other, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
neg AS (
  SELECT p.anchor, p.other AS positive, p.score AS positive_score, n.other AS negative, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM pos p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id,
       positive_score, negative_score
FROM neg WHERE rank <= 10
"""

OP13 = f"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS bytes FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
w AS (
  SELECT 'd' AS side, doc_id AS id, {_WORDS} AS w FROM documents
  UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark),
f AS (
  SELECT side, id, unnest(w) AS x FROM w
  UNION ALL
  SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w)),
spelled AS (SELECT x, hex(x) AS h FROM (SELECT DISTINCT x FROM f)),
b AS (
  SELECT x, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
      lambda c, y: xor(c >> 8, bytes[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc),
placed AS (SELECT side, id, bucket FROM f JOIN b USING (x)),
n AS (SELECT count(*) FILTER (WHERE side = 'd') AS all_s, count(*) FILTER (WHERE side = 't') AS all_t FROM placed),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (CAST(all_s AS DOUBLE) + 10000)) / ((s + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, CAST(count(*) FILTER (WHERE side = 'd') AS DOUBLE) AS s,
               CAST(count(*) FILTER (WHERE side = 't') AS DOUBLE) AS t FROM placed GROUP BY bucket), n),
weights AS (
  SELECT id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) +
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || id)[1:8] AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score,
         coalesce(weight, 0) AS weight
  FROM w LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS enters
  FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 25 * enters // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES = {"op4_phrase_index": OP4, "op9_recompression": OP9, "op12_hard_negatives": OP12, "op13_importance": OP13}
