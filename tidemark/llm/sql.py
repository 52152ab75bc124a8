"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         instr(coalesce(url, ''), '://') > 0 AS real
  FROM pages),
h AS (
  SELECT page_id, real, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM h JOIN rules ON real AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM h LEFT JOIN fits ON fits.page_id = h.page_id AND k = 1"""

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, source AS host, {WORDS} AS words, coalesce(text, '') AS text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM places) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id),
f AS (
  SELECT *, 10 * n_symbols > n_words AS f1, 10 * n_repeat_words * 10 > 10 * n_words AS f2, 10 * n_dup_lines > 3 * n_lines AS f3,
         word_chars < 3 * n_words OR word_chars > 12 * n_words AS f4,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM c),
h AS (
  SELECT host, unnest([1, 2, 3, 4]) AS rule, count(*) AS n,
         unnest([count_if(f1), count_if(f2), count_if(f3), count_if(f4)]) AS bad
  FROM f GROUP BY host),
p AS (
  SELECT rule, sum(bad) / CAST(sum(n) AS DOUBLE) AS p, avg(bad / CAST(n AS DOUBLE)) AS m, avg((bad / CAST(n AS DOUBLE)) * (bad / CAST(n AS DOUBLE))) AS q
  FROM h GROUP BY rule),
s AS (
  SELECT rule, p, CASE WHEN q - 2 * p * m + p * p > 1e-12
                  THEN least(greatest(p * (1 - p) / (q - 2 * p * m + p * p) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s
  FROM p),
strict AS (
  SELECT host, list(h.rule) AS rules FROM h JOIN s ON h.rule = s.rule
  WHERE (bad + p * s.s) / (n + s.s) >= 0.5 GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((f1 AND list_contains(rules, 1)) OR (f2 AND list_contains(rules, 2))
         OR (f3 AND list_contains(rules, 3)) OR (f4 AND list_contains(rules, 4)), false) AS kept
FROM f LEFT JOIN strict ON strict.host IS NOT DISTINCT FROM f.host"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
places AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM places),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM firsts, range(13) AS r(k) WHERE first < doc_id),
spread AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
kept AS (
  SELECT spread.doc_id, string_agg(word, ' ' ORDER BY spread.i) AS kept, count(*) AS n
  FROM spread ANTI JOIN gone ON gone.doc_id = spread.doc_id AND gone.i = spread.i GROUP BY spread.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f"""

TOOL_CALLS = """
WITH e AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, role,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'call_' || turn WHEN 'assistant' THEN 'call_' || (turn - 1) END AS call_id
  FROM conversations),
n AS (
  SELECT conv_id AS c, call_id AS i, count_if(kind = 'call') AS calls, count_if(kind = 'result') AS results
  FROM e WHERE call_id IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, kind, call_id,
       CASE kind WHEN 'call' THEN CASE WHEN calls > 1 THEN 'duplicate' WHEN results > 0 THEN 'linked' ELSE 'no_result' END
                 WHEN 'result' THEN CASE WHEN calls > 0 THEN 'linked' ELSE 'orphan' END ELSE 'message' END AS status,
       turn AS order_turn, CAST(0 AS INTEGER) AS order_level, '' AS errors,
       CASE kind
         WHEN 'call' THEN '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"answer","type":"tool_call"}'
         WHEN 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || call_id || '","name":' || CASE WHEN calls > 0 THEN '"answer"' ELSE 'null' END || ',"type":"tool_result"}'
         ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"type":"message"}' END AS json
FROM e LEFT JOIN n ON conv_id = c AND call_id = i"""

RANKED_SEARCH = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, c GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""

MINHASH = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.y, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.y, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.x = s.doc_id"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, e.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op3_tool_calls": TOOL_CALLS,
    "op4_url_filter": URL_FILTER,
    "op5_quality_rules": QUALITY,
    "op6_substring_dedup": SUBSTRING,
    "op10_warc": WARC,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_minhash": MINHASH,
    "op13_hard_negatives": HARD_NEGATIVES,
}
