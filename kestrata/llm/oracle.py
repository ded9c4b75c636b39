"""DuckDB SQL for the operators that SQL can express.  The others are tested against brute force or held-out accuracy."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = r"""
WITH RECURSIVE steps(i, k, c) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        hex(encode(coalesce(text, ''))) AS x
    FROM documents),
t AS (
    SELECT doc_id, s, size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 8), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM d, crc),
b AS (SELECT *, CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15) AS BIGINT) AS h FROM t),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, s, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r),
q AS (SELECT *, pos * 24 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, pos - (shard * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard FROM q
"""

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS l FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])
        WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
r(id, comp) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(comp) AS comp FROM r GROUP BY id),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, coalesce(k.k, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""

OP4 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

OP5 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format("text")} AS l FROM benchmark),
bw AS (
    SELECT DISTINCT item, unnest(CASE WHEN len(l) >= 8 THEN list_transform(range(1, len(l) - 6), lambda i: array_to_string(l[i:i + 7], ' ')) ELSE [array_to_string(l, ' ')] END) AS g,
        least(len(l), 8) AS k FROM b WHERE len(l) > 0),
d AS (SELECT doc_id, {_ALNUM.format("text")} AS l FROM documents),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(l) - k + 2)) AS i, l FROM d, k WHERE len(l) >= k),
h AS (SELECT doc_id, i, dw.k, item FROM (SELECT doc_id, i, k, array_to_string(l[i:i + k - 1], ' ') AS g FROM dw) dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
f AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM f)),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY doc_id, run),
g AS (
    SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) IS NULL AS final FROM r),
k AS (
    SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)) || CASE WHEN final THEN substr(x, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept
    FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": OP2,
    "op3_ngram_jaccard_join": OP3,
    "op4_exact_top_k": OP4,
    "op5_benchmark_decontamination": OP5,
    "op10_suffix_array_dedup": OP10,
}
