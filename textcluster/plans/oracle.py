"""DuckDB SQL for the registered queries (the correctness oracle).

Every statement reads the given tables (``documents``, ``labels``, ``embeddings`` ...) as views and
aliases each column to the name the Spark query uses. Doubles are rounded to 6 decimals in both.
"""

from __future__ import annotations

from ..functions.stopwords import english_stop_words, sql_list
from ..operators.features import TfidfParams
from ..operators.hashing import HASH_FEATURES
from ..operators.report import DEFAULT_SEARCH_URL, RANK_DECIMALS

P = TfidfParams()
TOP_N = 20


def _tokens_cte(table: str = "documents", id_col: str = "doc_id", text: str = "text", stop: bool = True) -> str:
    where = f"WHERE term NOT IN {sql_list(english_stop_words())}" if stop else ""
    return f"""
toks AS (
  SELECT {id_col} AS doc_id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM {table}
),
kept AS (SELECT doc_id, term FROM toks {where}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY doc_id, term)"""


def _vocab_ctes(table: str = "documents", params: TfidfParams = P) -> str:
    return f"""
ndocs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {table}),
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
kept_terms AS (
  SELECT s.term, s.df, s.cf FROM stats s, ndocs
  WHERE s.df >= CAST({params.min_df!r} AS DOUBLE) * ndocs.n AND s.df <= CAST({params.max_df!r} AS DOUBLE) * ndocs.n
  ORDER BY s.cf DESC, s.term ASC LIMIT {params.max_features}
),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_idx, term, df, cf FROM kept_terms),
idf AS (SELECT v.term_idx, v.term, v.df, ln((1 + ndocs.n) / (1 + v.df)) + 1 AS idf FROM vocab v, ndocs)"""


def _weights_cte(norm: str = "l1") -> str:
    n = "sum(abs(w)) OVER (PARTITION BY doc_id)" if norm == "l1" else "sqrt(sum(w * w) OVER (PARTITION BY doc_id))"
    return f"""
w0 AS (SELECT tf.doc_id, i.term_idx, i.term, tf.tf, tf.tf * i.idf AS w FROM tf JOIN idf i USING (term)),
weights AS (SELECT doc_id, term_idx, term, tf, w / {n} AS weight FROM w0)"""


def _top_terms_sql(members: str, clusters: str, key: str, n: int = TOP_N) -> str:
    """Centroid = mean weight over members (zero vectors count); top n, zero-filled from the vocabulary."""
    return f"""
mem AS ({members}),
sizes AS (SELECT {key}, count(*) AS n_members FROM mem GROUP BY {key}),
cent AS (
  SELECT m.{key}, w.term, sum(w.weight) / s.n_members AS weight
  FROM weights w JOIN mem m USING (doc_id) JOIN sizes s ON s.{key} = m.{key}
  GROUP BY m.{key}, w.term, s.n_members
),
ranked AS (
  SELECT {key}, term,
         row_number() OVER (PARTITION BY {key} ORDER BY round(weight, {RANK_DECIMALS}) DESC, term ASC) AS rk
  FROM cent WHERE weight <> 0
),
tops AS (SELECT {key}, list(term ORDER BY rk) AS top FROM ranked WHERE rk <= {n} GROUP BY {key}),
fill AS (SELECT coalesce(list(term ORDER BY term), []) AS f FROM (SELECT term FROM vocab ORDER BY term LIMIT {n})),
kw AS (
  SELECT c.{key},
         array_to_string(list_slice(list_concat(coalesce(t.top, []),
             list_filter(fill.f, lambda x: NOT list_contains(coalesce(t.top, []), x))), 1, {n}), ', ') AS keywords
  FROM ({clusters}) c LEFT JOIN tops t ON t.{key} = c.{key}, fill
)"""


_EMB = """
e AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(unnest(embedding) AS DOUBLE) AS x,
         CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim
  FROM embeddings
),
cent AS (SELECT label AS cluster_id, dim, avg(x) AS value FROM e GROUP BY label, dim),
d AS (
  SELECT e.vec_id, c.cluster_id, sum((e.x - c.value) * (e.x - c.value)) AS dist2
  FROM e JOIN cent c ON c.dim = e.dim GROUP BY e.vec_id, c.cluster_id
),
best AS (
  SELECT vec_id, cluster_id, dist2 FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist2, cluster_id) AS rn FROM d) WHERE rn = 1
),
moved AS (SELECT b.cluster_id, e.dim, avg(e.x) AS value FROM e JOIN best b USING (vec_id) GROUP BY b.cluster_id, e.dim),
step AS (
  SELECT cluster_id, dim, value FROM moved
  UNION ALL SELECT cluster_id, dim, value FROM cent WHERE cluster_id NOT IN (SELECT cluster_id FROM moved)
)"""


_XML = r"""
x AS (
  SELECT doc_id, lang, CAST(doc_id + 10000000 AS VARCHAR) AS permalink,
         trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r\n]+', ' ', 'g')) AS title,
         trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS body
  FROM documents
),
xv AS (
  SELECT doc_id, permalink, title, CASE WHEN lang = 'es' THEN title ELSE body END AS content, lang
  FROM x WHERE lang <> 'de'
)"""

_TEXT = r"""
t0 AS (
  SELECT doc_id, lang, source, text,
         CASE WHEN lang = 'de' THEN chr(10) || chr(10) || chr(10) ELSE chr(10) || chr(10) END AS gap
  FROM documents
),
t1 AS (
  SELECT doc_id, lang,
         CAST(doc_id AS VARCHAR) || '. J ' || coalesce(source, '') || '. 2017.' || gap
         || regexp_replace(split_part(text, chr(10), 1), '[\r\n]', ' ', 'g') || gap
         || CASE WHEN lang = 'es' THEN '' ELSE 'Auth A.' || gap || 'Author information: X' || gap END
         || regexp_replace(text, '[\r\n]', ' ', 'g') || gap
         || 'PMID: ' || CAST(doc_id + 10000000 AS VARCHAR) || '  [Indexed]' || chr(10) AS record
  FROM t0
),
t2 AS (
  SELECT doc_id, record,
         list_transform(string_split(replace(regexp_replace(regexp_replace(
             regexp_replace(record, '\r\n?', chr(10), 'g'), '^\n+|\n+$', '', 'g'),
             '\n[ \t]*\n(?:[ \t]*\n)*', 'SEGMENTBREAK', 'g'), chr(10), ' '), 'SEGMENTBREAK'),
             lambda s: trim(s)) AS segs
  FROM t1
),
t3 AS (
  SELECT doc_id, record, CASE WHEN len(segs) >= 5 THEN segs[5] END AS content,
         CASE WHEN len(segs) >= 5 THEN segs[2] END AS title
  FROM t2
),
tx AS (
  SELECT doc_id, title, content,
         CASE WHEN title IS NOT NULL THEN nullif(regexp_extract(record, 'PMID:\s+(\d{8})', 1), '') END AS permalink
  FROM t3
)"""


def oracle_sql() -> dict[str, str]:
    tok = _tokens_cte()
    voc = _vocab_ctes()
    q: dict[str, str] = {}
    parts = (
        "WITH i AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM documents), "
        "p AS (SELECT doc_id, idx, CAST(greatest(1, ceil(idx / 100)) AS BIGINT) AS part FROM i) "
    )
    q["part_numbers"] = parts + "SELECT doc_id, idx, part FROM p"
    q["sparse_part_numbers"] = parts + "SELECT doc_id, doc_id * 10000000 AS seq, idx, part FROM p"
    q["running_count"] = (
        parts + ", c AS (SELECT part, count(*) AS n_docs FROM p GROUP BY part) "
        "SELECT part, n_docs, CAST(sum(n_docs) OVER (ORDER BY part) AS BIGINT) AS running_total FROM c"
    )
    q["first_n"] = (
        "SELECT doc_id, CAST(doc_id + 10000000 AS VARCHAR) AS permalink FROM documents ORDER BY doc_id LIMIT 100"
    )
    q["staged_roundtrip"] = parts + (
        "SELECT d.doc_id, p.part, CAST(d.doc_id + 10000000 AS VARCHAR) AS permalink, "
        "split_part(d.text, chr(10), 1) AS title, d.text AS content FROM documents d JOIN p USING (doc_id)"
    )
    q["union_parts"] = parts + "SELECT doc_id, part, CAST(doc_id + 10000000 AS VARCHAR) AS permalink FROM p"
    q["vector_tsv"] = (
        "SELECT array_to_string(list_transform(embedding, lambda x: "
        "CAST(CAST(round(CAST(x AS DOUBLE), 6) AS DECIMAL(38,6)) AS VARCHAR)), chr(9)) AS line FROM embeddings"
    )
    q["xml_extract"] = f"WITH {_XML} SELECT doc_id, permalink, title, content FROM xv"
    q["xml_fallback"] = f"WITH {_XML} SELECT doc_id, permalink, content FROM xv WHERE lang = 'es'"
    q["xml_reject_counts"] = (
        "SELECT count(*) AS n_read, count(*) FILTER (WHERE lang <> 'de') AS n_valid, "
        "count(*) FILTER (WHERE lang = 'de') AS n_rejected FROM documents"
    )
    q["xml_pages"] = (
        "SELECT page_id, CAST(page_id + 20000000 AS VARCHAR) AS permalink, "
        r"trim(regexp_replace(url, '[ \t\r\n]+', ' ', 'g')) AS title, "
        r"trim(regexp_replace(html, '[ \t\r\n]+', ' ', 'g')) AS content FROM pages"
    )
    q["parser_identity"] = q["xml_extract"]
    q["parser_custom"] = f"WITH {_XML} SELECT doc_id, permalink, title AS content FROM xv"
    q["project_stream"] = f"WITH {_XML} SELECT permalink, content FROM xv"
    q["text_segments"] = (
        f"WITH {_TEXT} SELECT doc_id, CAST(generate_subscripts(segs, 1) - 1 AS BIGINT) AS seg_idx, "
        "unnest(segs) AS segment FROM t2"
    )
    q["text_extract"] = f"WITH {_TEXT} SELECT doc_id, permalink, title, content FROM tx"
    q["text_lines_extract"] = q["text_extract"]
    q["drop_null"] = (
        f"WITH {_TEXT} SELECT doc_id, permalink, title, content FROM tx "
        "WHERE doc_id IS NOT NULL AND permalink IS NOT NULL AND title IS NOT NULL AND content IS NOT NULL"
    )
    q["dir_scan"] = "SELECT lang, count(*) AS n_records FROM documents GROUP BY lang"
    q["centroid_update"] = f"WITH {_EMB} SELECT cluster_id, dim, round(value, 6) AS value FROM cent"
    q["assign_nearest"] = f"WITH {_EMB} SELECT vec_id, cluster_id, round(dist2, 6) AS dist2 FROM best"
    q["inertia"] = f"WITH {_EMB} SELECT count(*) AS n_vectors, round(sum(dist2), 4) AS inertia FROM best"
    q["lloyd_step"] = f"WITH {_EMB} SELECT cluster_id, dim, round(value, 6) AS value FROM step"
    q["term_freq"] = f"WITH {tok} SELECT doc_id, term, tf FROM tf"
    q["doc_freq"] = f"WITH {tok} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term"
    q["vocabulary"] = f"WITH {tok}, {voc} SELECT term_idx, term, df, cf FROM vocab"
    q["vocabulary_summary"] = q["vocabulary"]
    q["idf"] = f"WITH {tok}, {voc} SELECT term_idx, term, df, round(idf, 6) AS idf FROM idf"
    for norm in ("l1", "l2"):
        q[f"tfidf_{norm}"] = (
            f"WITH {tok}, {voc}, {_weights_cte(norm)} "
            "SELECT doc_id, term_idx, term, tf, round(weight, 6) AS weight FROM weights"
        )
    q["vector_dense_dump"] = (
        f"WITH {tok}, {voc}, {_weights_cte('l1')}, "
        "grid AS (SELECT d.doc_id, v.term_idx FROM documents d, vocab v) "
        "SELECT g.doc_id, list(round(coalesce(w.weight, 0.0), 6) ORDER BY g.term_idx) AS vec "
        "FROM grid g LEFT JOIN weights w ON w.doc_id = g.doc_id AND w.term_idx = g.term_idx GROUP BY g.doc_id"
    )
    top_lang = _top_terms_sql(
        "SELECT doc_id, lang FROM documents", "SELECT DISTINCT lang FROM documents", "lang"
    )
    q["top_terms"] = f"WITH {tok}, {voc}, {_weights_cte('l1')}, {top_lang} SELECT lang, keywords FROM kw"
    top_q = _top_terms_sql(
        "SELECT d.doc_id, CAST(coalesce(l.quality, 2) AS INTEGER) AS cluster_id FROM documents d LEFT JOIN labels l USING (doc_id)",
        "SELECT CAST(range AS INTEGER) AS cluster_id FROM range(3)",
        "cluster_id",
    )
    q["top_terms_report"] = (
        f"WITH {tok}, {voc}, {_weights_cte('l1')}, {top_q} "
        "SELECT cluster_id, format('Cluster #: {}   Top terms: {}', cluster_id, keywords) AS line FROM kw"
    )
    collate = f"""
WITH mem AS (
  SELECT CAST(coalesce(l.quality, 2) AS INTEGER) AS cluster_id, d.doc_id AS ord, CAST(d.doc_id + 10000000 AS VARCHAR) AS member
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
paged AS (
  SELECT cluster_id, member, ord,
         CAST((row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1) // 100000 AS BIGINT) AS page
  FROM mem
),
urls AS (
  SELECT cluster_id, page, '{DEFAULT_SEARCH_URL}' || replace(string_agg(member, ' ' ORDER BY ord), ' ', '%20')
         AS clickable_content
  FROM paged GROUP BY cluster_id, page
)
SELECT cluster_id, page, clickable_content FROM urls
UNION ALL
SELECT CAST(r.range AS INTEGER) AS cluster_id, CAST(0 AS BIGINT) AS page, '{DEFAULT_SEARCH_URL}' AS clickable_content
FROM range(4) r WHERE r.range NOT IN (SELECT cluster_id FROM mem)"""
    q["stream_replay"] = q["union_parts"]
    q["stream_stage"] = f"WITH {_XML} SELECT permalink, title, body AS content FROM x"
    q["collate_urls"] = collate
    q["export_roundtrip"] = (
        f"WITH {tok}, {voc}, {_weights_cte('l1')}, {top_q}, urls4 AS ({collate}) "
        "SELECT u.cluster_id, u.page, u.clickable_content, k.keywords FROM urls4 u LEFT JOIN kw k ON k.cluster_id = u.cluster_id"
    )
    member = "SELECT doc_id, CAST(doc_id + 10000000 AS VARCHAR) AS permalink"
    for name in ("kmeans_membership", "kmeans_pp_membership", "kmeans_one_scan", "minibatch_membership", "stream_minibatch"):
        q[name] = f"{member}, true AS in_range, true AS is_nearest FROM documents"
    q["features_reuse"] = f"{member}, true AS same FROM documents"
    q["restarts_step"] = """
WITH e AS (
  SELECT vec_id, CAST(label AS INTEGER) AS own0, CAST(vec_id % 3 AS INTEGER) AS own1, CAST(unnest(embedding) AS DOUBLE) AS x,
         generate_subscripts(embedding, 1) AS dim
  FROM embeddings
),
c AS (
  SELECT 0 AS run, own0 AS own, dim, avg(x) AS v FROM e GROUP BY ALL
  UNION ALL SELECT 1 AS run, own1 AS own, dim, avg(x) AS v FROM e GROUP BY ALL
),
ranked AS (SELECT run, CAST(dense_rank() OVER (PARTITION BY run ORDER BY own) - 1 AS INTEGER) AS cluster_id, dim, v FROM c),
d AS (
  SELECT r.run, r.cluster_id, e.vec_id, sum((e.x - r.v) * (e.x - r.v)) AS d2, sum(e.x) AS entries
  FROM e JOIN ranked r USING (dim) GROUP BY ALL
),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run, vec_id ORDER BY d2, cluster_id) = 1),
got AS (SELECT run, cluster_id, count(*) AS n, sum(d2) AS cost, sum(entries) AS entries FROM near GROUP BY ALL)
SELECT k.run, k.cluster_id, coalesce(n, 0) AS n_members, round(coalesce(cost, 0), 4) AS cost, round(coalesce(entries, 0), 4) AS entries
FROM (SELECT DISTINCT run, cluster_id FROM ranked) k LEFT JOIN got USING (run, cluster_id)"""
    q["kmeans_best_of_n"] = "SELECT count(*) AS n_docs, CAST(3 AS INTEGER) AS n_runs, true AS kept_is_least FROM documents"
    known = f"CAST(least({TOP_N}, (SELECT count(*) FROM vocab)) AS BIGINT)"
    q["kmeans_keywords"] = f"WITH {tok}, {voc} SELECT CAST(range AS INTEGER) AS cluster_id, {known} AS n_terms, {known} AS n_known FROM range(20)"
    q["lda_topics"] = f"WITH {tok}, {voc} SELECT CAST(range AS INTEGER) AS topic, {known} AS n_terms, {known} AS n_known, CAST(1.0 AS DOUBLE) AS total FROM range(10)"
    q["minibatch_epochs"] = (
        "SELECT count(*) AS n_docs, CAST(30 * ceil(count(*) / 50000.0) AS BIGINT) AS n_steps, 30 * count(*) AS n_folded FROM documents"
    )
    q["minibatch_cost"] = "SELECT count(*) AS n_docs, CAST(20 AS INTEGER) AS k, true AS near_full_fit FROM documents"
    q["hash_tf"] = f"""WITH {tok},
h AS (SELECT doc_id, tf, md5(term) AS m FROM tf),
b AS (
  SELECT doc_id, CAST(concat('0x', m[1:8]) AS BIGINT) % {HASH_FEATURES} AS bucket,
         sum(CASE WHEN CAST(concat('0x', m[9:10]) AS BIGINT) % 2 = 1 THEN -tf ELSE tf END) AS v
  FROM h GROUP BY ALL HAVING v <> 0
),
df AS (SELECT bucket, count(*) AS df FROM b GROUP BY bucket),
w AS (
  SELECT doc_id, bucket, v * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM b JOIN df USING (bucket)
)
SELECT doc_id, bucket, round(w / sum(abs(w)) OVER (PARTITION BY doc_id), 6) AS weight FROM w"""
    q["stream_hash"] = q["hash_tf"]
    q["end_to_end_tfidf"] = f"WITH {_XML} SELECT permalink FROM x"
    q["end_to_end_hashing"] = f"WITH {_TEXT} SELECT permalink, true AS in_range FROM tx WHERE content IS NOT NULL AND permalink IS NOT NULL"
    q["staged_per_source"] = q["dir_scan"]
    q["record_numbers"] = (
        "SELECT f AS in_format, CAST(n AS BIGINT) AS n_records, CAST(n - 1 AS BIGINT) AS last, true AS in_order "
        "FROM (SELECT count(*) AS n FROM documents), (SELECT unnest(['xml', 'txt']) AS f)"
    )
    return q
