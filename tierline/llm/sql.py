"""DuckDB SQL for the registered queries that SQL can express.

Written from the contracts, not from the Spark code.  Values that both sides
need (the seed of the shuffle, the weights) are stated here again.
"""

EXACT_DEDUP = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS pos
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::DOUBLE AS weight,
         source_size * 3::DOUBLE AS lim
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY lim / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT first(level ORDER BY lim / weight, source_rank) AS level FROM levels WHERE lim > weight * level),
targets AS (
  SELECT l.source, l.source_size, l.source_rank,
         CASE WHEN w.level IS NULL THEN l.lim ELSE least(l.lim, l.weight * w.level) END AS target
  FROM levels l CROSS JOIN water w),
queued AS (
  SELECT s.*, t.source_size, t.source_rank, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.pos, s.doc_id NULLS LAST, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS finish,
         row_number() OVER () AS row_no
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT q.row_no, q.size,
         sum(q.size) OVER (ORDER BY (q.finish::DOUBLE + turn * q.source_size) / q.target, q.source_rank, turn, q.pos, q.doc_id, q.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM queued q CROSS JOIN range(3) r(turn) WHERE q.size > 0),
taken AS (
  SELECT row_no, sum(size) AS taken FROM turns
  WHERE total <= (SELECT sum(source_size) FROM targets) GROUP BY row_no)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t USING (row_no)
"""

# CRC-32 byte by byte; a list's first element starts the reduction
PREFIX_TRIE = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i)) t),
own AS (
  SELECT conv_id, list(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || length(coalesce(text, ''))::VARCHAR || ':' || coalesce(text, '')
                       ORDER BY turn NULLS FIRST) AS turns,
         list(length(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                              lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 6 AS h
  FROM own o CROSS JOIN crc_table),
rebuilt AS (
  SELECT c.conv_id,
         list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns,
         list_concat(coalesce(f.sizes, [])[1:c.h], c.sizes[c.h + 1:]) AS sizes
  FROM hashed c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 100),
path AS (
  SELECT conv_id, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size,
         sha256(array_to_string(turns[1:d], '')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], '')) END AS parent
  FROM (SELECT conv_id, turns, sizes, unnest(range(len(turns) + 1)) AS d FROM rebuilt) t),
nodes AS (
  SELECT d, key, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM path GROUP BY d, key),
children AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.key = c.key),
-- the ancestors of a node are the prefixes of its smallest member
below AS (
  SELECT p.d, p.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM counted n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON n.d = b.d AND n.key = b.key LEFT JOIN nodes u ON u.d = n.d - 1 AND u.key = n.parent
"""

IMPORTANCE = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i)) t),
texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, false AS goal, text FROM documents
  UNION ALL SELECT -1, NULL, true, text FROM benchmark),
words AS (
  SELECT row_no, doc_id, goal,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT row_no, goal, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS run
  FROM words CROSS JOIN range(1, 4) r(n)),
counted AS (SELECT row_no, goal, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT DISTINCT run, hex(encode(run)) AS x FROM counted),
hashed AS (
  SELECT run, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(len(x) // 2),
             lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
           lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed CROSS JOIN crc_table),
found AS (SELECT c.row_no, c.goal, h.bucket, c.n FROM counted c JOIN hashed h ON c.run = h.run),
sizes AS (SELECT coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS t FROM found),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(sum(n) FILTER (goal), 0) + 1)::DOUBLE * (any_value(z.s) + 10000))
                                 / ((coalesce(sum(n) FILTER (NOT goal), 0) + 1)::DOUBLE * (any_value(z.t) + 10000))))::BIGINT AS gain
  FROM found CROSS JOIN sizes z GROUP BY bucket),
weights AS (
  SELECT f.row_no, sum(f.n)::BIGINT AS n_features, sum(f.n * g.gain)::BIGINT AS weight
  FROM found f JOIN gains g ON f.bucket = g.bucket WHERE NOT goal GROUP BY f.row_no),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
         coalesce(x.weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(d.doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE)
                                                      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words d LEFT JOIN weights x ON d.row_no = x.row_no WHERE NOT d.goal),
placed AS (
  SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n_able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n_able // 100 THEN place END AS rank FROM placed
"""

ORACLE: dict[str, str] = {
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_source_mixing": MIXING,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_importance_resampling": IMPORTANCE,
}
