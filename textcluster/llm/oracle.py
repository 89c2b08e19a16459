"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(h.keeper <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32 = " || ".join(f"substr('{DIGITS}', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))

OP1 = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM rows GROUP BY h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {BASE32.replace("(h,", "(r.h,")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM rows r JOIN firsts f ON r.h = f.h
"""

OP4 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH items AS (SELECT item_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN wins x ON p.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT word_no) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word_no FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

OP10 = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 3) - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT c.x, c.y FROM common c JOIN sizes a ON a.doc_id = c.x JOIN sizes b ON b.doc_id = c.y
  WHERE 100 * c.n >= 90 * (a.n + b.n - c.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

BLANK = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
NORM = f"array_to_string({BLANK.format(LOWER.format('line'))}, ' ')"

OP11 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS doc, doc_id, source, coalesce(text, '') AS t,
         {BLANK.format("coalesce(text, '')")} AS w FROM documents),
lines AS MATERIALIZED (
  SELECT r, doc, source, line, {NORM} AS key, len({BLANK.format("line")}) AS words
  FROM (SELECT r, doc, source, unnest(string_split(t, chr(10))) AS line FROM docs)),
hosts AS (SELECT source, count(DISTINCT doc) AS n FROM docs GROUP BY source),
held AS (SELECT source, key, count(DISTINCT doc) AS n FROM lines WHERE key <> '' GROUP BY source, key),
common AS (SELECT h.source, h.key FROM held h JOIN hosts s ON h.source IS NOT DISTINCT FROM s.source WHERE h.n >= 10 AND 100 * h.n > s.n),
gone AS (SELECT r, sum(words) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.key = c.key GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE key <> '' GROUP BY r),
wins AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS j FROM twice WHERE n > 1) GROUP BY r),
counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM docs d LEFT JOIN dups ON d.r = dups.r LEFT JOIN rep ON d.r = rep.r LEFT JOIN gone ON d.r = gone.r),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - gone >= 25 AND 100 * (n_words - gone) >= 30 * n_words AS kept
FROM failed
"""

#: unsigned crc32 of a decimal number, bit by bit
CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda acc, x: xor(xor(acc, x) >> 1, CASE WHEN xor(acc, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS size, turn,
         md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM t),
convs AS MATERIALIZED (SELECT conv_id, {CRC32.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c.conv_id, o.k, o.digest, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, o.k, o.digest, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
seqs AS MATERIALIZED (
  SELECT c.conv_id, coalesce(string_agg(p.digest, '' ORDER BY p.k), '') AS key, list(p.size ORDER BY p.k) FILTER (WHERE p.k IS NOT NULL) AS sizes
  FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, substr(key, 1, 32 * d) AS p, length(key) = 32 * d AS ends, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, CAST(unnest(range(0, length(key) // 32 + 1)) AS BIGINT) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends
  FROM prefixes GROUP BY p),
kids AS MATERIALIZED (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
under AS (
  SELECT substr(w.p, 1, 32 * a) AS p, sum(CASE WHEN w.leaf THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.size) AS saved
  FROM (SELECT x.*, kids.p IS NULL AS leaf, unnest(range(0, x.d + 1)) AS a FROM nodes x LEFT JOIN kids ON kids.p = x.p) w GROUP BY 1)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(under.leaves AS BIGINT) AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN kids ON kids.p = x.p JOIN under ON under.p = x.p
LEFT JOIN nodes up ON x.d > 0 AND up.p = substr(x.p, 1, 32 * (x.d - 1))
"""

TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {TERMS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM docs WHERE len(w) > 0),
tfs AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT item_id, text, term, count(*) AS q FROM (
    SELECT item_id, text, unnest({TERMS.format(LOWER.format("coalesce(text, '')"))}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, text, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, totals),
lengths AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * nn) // ll AS m FROM docs, totals WHERE len(w) > 0),
scored AS (
  SELECT a.item_id, a.text, d.r, any_value(d.doc_id) AS doc_id, CAST(sum(a.q * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * d.m))) AS BIGINT) AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN tfs t ON t.term = a.term JOIN lengths d ON d.r = t.r GROUP BY a.item_id, a.text, d.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1, "op4_exact_topk": OP4, "op2_line_dedup": OP2, "op9_decontamination": OP9, "op10_ngram_jaccard": OP10,
        "op11_line_rules": OP11, "op12_prefix_trie": OP12, "op13_lexical_search": OP13,
    }
