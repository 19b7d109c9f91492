"""DuckDB twins of the corpus queries."""
from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: rows (doc_id, source, size, hash), then sources with their targets, then the border hash of each source
_MIX = r"""
items AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM items GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)
             - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, c.level * w) END AS target
  FROM weighed, chosen c),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
borders AS (
  SELECT source, max(hash) AS border FROM (
    SELECT h.source, h.hash, sum(h.size) OVER (PARTITION BY h.source ORDER BY h.hash) - h.size / 2.0 AS middle,
           b.target - b.whole * b.source_size AS budget
    FROM (SELECT source, hash, sum(size) AS size FROM items GROUP BY source, hash) h
    JOIN budgets b ON h.source IS NOT DISTINCT FROM b.source)
  WHERE middle <= budget GROUP BY source)
"""

MIXING = f"""
WITH {_MIX}
SELECT i.doc_id, i.size, b.source_size, b.target,
       least(b.whole + CASE WHEN i.hash <= r.border THEN 1 ELSE 0 END, 2) * i.size AS taken
FROM items i JOIN budgets b ON i.source IS NOT DISTINCT FROM b.source
LEFT JOIN borders r ON i.source IS NOT DISTINCT FROM r.source
"""

#: doc_id, item_id, n_shingles, n_shared by exact counting of shared five-word shingles
DECONTAMINATION = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM item_words
  UNION ALL SELECT item_id, array_to_string(w, ' ') FROM item_words WHERE len(w) BETWEEN 1 AND 4),
short_lengths AS (SELECT DISTINCT len(w) AS m FROM item_words WHERE len(w) BETWEEN 1 AND 4),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM doc_words
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) FROM doc_words, short_lengths),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles::DOUBLE AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= ceil(round(n_shingles * 0.8, 6))
"""

#: CRC-32 (reflected polynomial 0xEDB88320) of distinct features, byte by byte: table of 256 entries by its rule, then one step a byte
RESAMPLING = r"""
WITH RECURSIVE
bits(byte, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT byte, c FROM bits WHERE k = 8),
words AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counted AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
steps(f, h, pos, c) AS (
  SELECT f, h, 1, 4294967295::BIGINT FROM names
  UNION ALL
  SELECT f, h, pos + 2, xor(x.c // 256, y.c)
  FROM steps x JOIN crc_table y ON y.byte = xor(x.c % 256, ('0x' || substring(h, pos, 2))::BIGINT) WHERE pos < len(h)),
buckets AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM steps WHERE pos > len(h)),
placed AS MATERIALIZED (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
per_bucket AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM per_bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((p.t + 1) * (a.s + 10000) / ((p.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM per_bucket p, totals a),
weights AS (SELECT id AS doc_id, sum(n * gain)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(len(w), 0) AS n_words, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights ON id = doc_id WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, CAST(greatest(n_words, 0) + greatest(n_words - 1, 0) + greatest(n_words - 2, 0) AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked
"""
