"""DuckDB SQL for the operators that SQL can express, over whole tables and whole texts."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, y FROM reach JOIN both_ways ON r = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM d, unnest(range(0, n - 99)) t(s)),
rep AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
marked AS (SELECT *, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS new FROM rep),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (
    SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE substr(h, 1, 2 * a[1]) || array_to_string(list_transform(range(1, spans + 1),
         lambda i: substr(h, 2 * b[i] + 1, 2 * (coalesce(a[i + 1], n) - b[i]))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[a-z0-9\x{80}-\x{10FFFF}]+')"

OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w, least(10, len(w)) AS n FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS g FROM i, unnest(range(1, len(w) - n + 2)) t(s) WHERE n > 0),
occ AS (
  SELECT doc_id, s, n, item_id FROM (
    SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS g FROM w, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(s)) JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
g AS (
  SELECT lang, k, array_to_string(w[s:s+k-1], ' ') AS phrase, count(*) AS f
  FROM words, (SELECT unnest([1, 2, 3]) AS k), unnest(range(1, len(w) - k + 2)) t(s) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT *, str_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, l.f AS l, r.f AS r, (1000000 * c.f::HUGEINT * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT c.*, unnest(range(1, k)) AS cut FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut+1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM cuts) WHERE i = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(f) AS m FROM inside GROUP BY 1, 2),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.m IS NULL OR 100 * m.m < 50 * a)
SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
w AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""

ORACLES = {"op4_ngram_jaccard_join": OP4, "op5_suffix_array_dedup": OP5, "op9_decontamination": OP9, "op12_collocations": OP12, "op13_hard_negatives": OP13}
