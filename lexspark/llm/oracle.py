"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

# Every 50-byte string (as 100 hex digits) with the smallest document it starts in; a document's
# strings that start in a smaller one give intervals, which are merged and cut out.
OP1 = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM t)),
held AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
marked AS (
  SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS starts
        FROM held)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM marked GROUP BY doc_id, span),
pieces AS (
  SELECT s.doc_id, a, b, substr(h, (2 * lag(b, 1, 0) OVER w + 1)::BIGINT, (2 * (a - lag(b, 1, 0) OVER w))::BIGINT) AS kept
  FROM spans s JOIN t USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept
  FROM pieces GROUP BY doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""

OP3 = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 13))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sizes GROUP BY source),
ordered AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sources WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST)),
levels AS (SELECT max((goal - below::DOUBLE) / w_left::DOUBLE) AS level FROM ordered),
placed AS (
  SELECT s.doc_id, s.size, o.source_size, least(o.cap::DOUBLE, l.level * o.w) AS target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN ordered o ON s.source IS NOT DISTINCT FROM o.source CROSS JOIN levels l),
cut AS (
  SELECT *, round(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM cut
"""

OP4 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""

OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
c AS (
  SELECT doc_id, s, len(s) AS n,
         CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM s),
u AS (SELECT doc_id, n, unnest(s) AS g FROM c WHERE class_id = doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM c WHERE class_id = doc_id
  UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.doc_id, n::BIGINT AS n_shingles, class_id, component_id, coalesce(n_links, 0) AS n_links
FROM c JOIN component ON component.id = c.class_id LEFT JOIN degree ON degree.id = c.class_id
"""

OP7 = r"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY t)
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * c.a),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000
"""

# CRC-32 of each distinct feature, byte by byte over a table made by rule.
OP13 = r"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
texts AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents
          UNION ALL SELECT 'b', NULL, -row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
                                  list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM w),
bytes AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
hashed AS (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2),
      lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM bytes, crc_table),
found AS (SELECT kind, row, bucket, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY ALL),
sums AS (
  SELECT bucket, sum(CASE WHEN kind = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN kind = 'b' THEN n ELSE 0 END)::DOUBLE AS t
  FROM found GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((sums.t + 1) * (totals.s + 10000) / ((sums.s + 1) * (totals.t + 10000))))::BIGINT AS gain
  FROM sums, totals),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket)
            WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weights USING (row) WHERE kind = 'd'),
ordered AS (SELECT *, n_words >= 20 AS may, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                   5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= drawn THEN place END AS rank FROM ordered
"""

ORACLE = {"op1_suffix_dedup": OP1, "op3_mix_sources": OP3, "op4_vector_top_k": OP4, "op5_jaccard_join": OP5,
          "op7_exact_dedup": OP7, "op12_collocations": OP12, "op13_resample": OP13}
