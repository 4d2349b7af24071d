"""SQL twins of the document queries, for DuckDB over the same tables."""

#: the 256 byte steps of the unsigned crc32, from its polynomial
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(list_concat([i], range(8)),
         lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS v FROM range(256) x(i)))"""

#: crc32 of the bytes that are given as upper-case hex digits; needs crc_table in FROM
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, strlen({0}) // 2), lambda i: ('0x' || substr({0}, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""

SHARD_SQL = f"""
WITH {CRC_TABLE},
sized AS (
  SELECT doc_id, size, {CRC32.format("digits")} AS text_crc32
  FROM (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents), crc_table
),
running AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole,
         row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place FROM sized
),
placed AS (SELECT *, least(15, CAST(2 * upto - size AS BIGINT) * 16 // CAST(2 * whole AS BIGINT)) AS shard FROM running)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  ) GROUP BY ALL
),
hashed AS (SELECT run, times, {CRC32.format("digits")} AS h FROM (SELECT *, hex(encode(id || ':' || run)) AS digits FROM runs), crc_table),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped GROUP BY word HAVING sum(times) >= 3 AND length(word) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)
),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, word AS at, form AS next FROM told
  UNION ALL SELECT walk.word, walk.next, t.form FROM walk JOIN told t ON t.word = walk.next
)
SELECT t.word, t.form, walk.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN walk ON walk.word = t.word AND walk.next IS NULL
"""

URL_SQL = r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
),
rules(host, path, decision) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fitting AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(decision, length(r.host || r.path)) AS decision
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id
),
marked AS (
  SELECT DISTINCT regexp_extract(host, '(?:^|\.)((?:[^.]*-)?(?:ads|adult|bets|casino|pills|spam)(?:-[^.]*)?\..+)$', 1) AS host FROM parts
),
held AS (
  SELECT page_id, arg_max(m.host || '/', length(m.host)) AS listed
  FROM parts p JOIN marked m ON m.host <> '' AND (p.host = m.host OR ends_with(p.host, '.' || m.host)) AND starts_with(p.path, '/') GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.decision, CASE WHEN h.listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, h.listed
FROM parts p LEFT JOIN fitting f USING (page_id) LEFT JOIN held h USING (page_id)
"""

NEGATIVE_SQL = """
WITH rows_in AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.parts, b.parts) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
