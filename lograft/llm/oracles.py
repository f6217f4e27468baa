"""What the queries of this subpackage should return, as SQL over the same tables."""

from __future__ import annotations

#: Repeats on the words or bytes of a text, given windows (doc_id, i, s) of ``{n}`` units.
_SPANS = """
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win)
  WHERE m < doc_id),
run AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + {n} THEN 0 ELSE 1 END AS new
  FROM dup WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (
  SELECT doc_id, min(i) AS a, max(i) + {n} AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run)
  GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span)
"""

SUFFIX_ARRAY = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
{_SPANS.format(n=50)},
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z,
    string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
      lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d)),
{_SPANS.format(n=13)},
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_repeats, max(b) AS z,
    flatten(list(w[z + 1:a] ORDER BY a)) AS head
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_repeats, 0) AS n_repeats,
  sha256(array_to_string(list_concat(coalesce(head, []), w[coalesce(z, 0) + 1:]), ' '))
    AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
    list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY x, y),
link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, link.y FROM reach r JOIN link ON r.y = link.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: CRC-32 as a fold over bytes; its table follows from the polynomial.
SHARDING = """
WITH RECURSIVE t(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS m FROM t WHERE k = 8),
d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
    CASE WHEN doc_id IS NULL THEN 'null' ELSE 'k' || doc_id END AS key
  FROM documents),
u AS (
  SELECT doc_id, key, length(h) // 2 + 1 AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(range(0, length(h) // 2),
          lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, m[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    list_transform(range(0, 9),
      lambda s: ('0x' || substr(md5(key || '/' || s), 1, 12))::BIGINT) AS score
  FROM d, crc),
p AS (
  SELECT *, list_position(score, list_max(score[1:8])) - 1 AS shard,
    list_position(score, list_max(score)) - 1 AS grown FROM u)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(key)) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM p
"""
