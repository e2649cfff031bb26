"""SQL for those queries of this subpackage that SQL can express, over the same Parquet tables."""

from __future__ import annotations

from graphloom.llm.url_filters import NEEDED, RULES, SOFT, STRICT

#: Components of p(a, b), pairs of ids in both orders: the smallest id that each id reaches.
_REACHED = "r(id, near) AS (SELECT a, least(a, b) FROM p UNION SELECT p.a, r.near FROM r JOIN p ON p.b = r.id WHERE r.near < p.a), c AS (SELECT id, min(near) AS least FROM r GROUP BY id)"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
u AS (SELECT min(doc_id) AS u, list(doc_id) AS same, any_value(n) AS n, h FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY doc_id) GROUP BY h),
k AS (SELECT s.g, u.u, u.n FROM s JOIN u ON u.u = s.doc_id),
x AS (SELECT a.u AS a, b.u AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter FROM k a JOIN k b ON a.g = b.g AND a.u < b.u AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM x WHERE 100 * inter >= 80 * (na + nb - inter)),
p AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT u, unnest(same) FROM u UNION SELECT unnest(same), u FROM u), {_REACHED}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
"""

OP4 = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) END AS bytes FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc ROWS UNBOUNDED PRECEDING) - size AS begin_, sum(size) OVER () AS total FROM k),
d AS (SELECT *, least(15, floor((begin_ + size / 2) * 16 / total))::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d
"""

OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
p AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_REACHED}, m AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(m.n, 0) AS n_links, coalesce(c.least, vec_id) AS component_id, coalesce(c.least, vec_id) = vec_id AS kept FROM v LEFT JOIN m ON m.a = vec_id LEFT JOIN c ON c.id = vec_id
"""

#: Every word of a text as crc32 modulo 10000, for tables d(id, text).
OP11 = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents WHERE text IS NOT NULL),
v AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT w FROM w UNION SELECT w FROM v), t),
s AS (SELECT b, count(*) AS s FROM w JOIN k USING (w) GROUP BY b), g AS (SELECT b, count(*) AS t FROM v JOIN k USING (w) GROUP BY b),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM g), 0)::DOUBLE AS t_all),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (t_gain.s_all + 10000) / ((s::DOUBLE + 1) * (t_gain.t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN g USING (b), n AS t_gain),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN k USING (w) JOIN gain USING (b) GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, (CASE WHEN n_features >= 20 AND place <= floor(10 * n / 100) THEN place END)::BIGINT AS rank FROM r
"""

_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
_TERMS = ", ".join(f"('{t}', 1, 0)" for t in STRICT) + ", " + ", ".join(f"('{t}', 0, {w})" for t, w in SOFT.items())
_APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"

OP12 = f"""
WITH rules(rule, verdict) AS (VALUES {_RULES}), terms(term, strict, soft) AS (VALUES {_TERMS}),
p AS (SELECT row_number() OVER () AS row, page_id, url, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  translate(CASE WHEN contains(url, '://') THEN rest ELSE coalesce(url, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p),
e AS (SELECT * EXCLUDE (low), ' ' || translate(array_to_string(list_transform(regexp_extract_all(low, '%[2-7][0-9a-f]|[^%]+|%'), lambda x: CASE WHEN len(x) = 3 AND x[1] = '%' THEN chr(('0x' || x[2:3])::INT) ELSE x END), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ' AS said FROM h),
f AS (SELECT row, first(rule ORDER BY len(rule) DESC, rule) AS rule, first(verdict ORDER BY len(rule) DESC, rule) AS verdict FROM h JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[position('/' IN rule):]) GROUP BY row),
n AS (SELECT row, sum(strict) AS n_strict, count(*) - sum(strict) AS n_soft, sum(soft) AS weight FROM e JOIN terms ON contains(said, term) AND regexp_matches(said, '{_APART}' || term || '{_APART}') GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN n_strict > 0 OR weight >= {NEEDED} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n_strict, 0)::BIGINT AS n_strict, coalesce(n_soft, 0)::BIGINT AS n_soft
FROM e LEFT JOIN f USING (row) LEFT JOIN n USING (row)
"""

OP13 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
y AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * (len(text) - len(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > low, low IS NOT NULL) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN y USING (doc_id)),
c AS (SELECT part, a::INT + b::INT * 2 + c::INT * 4 + d::INT * 8 + e::INT * 16 AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END))::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE len(filter_order) = 5),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

SQL = {
    "op2_jaccard_join": OP2,
    "op4_sharding": OP4,
    "op10_embedding_dedup": OP10,
    "op11_importance_resampling": OP11,
    "op12_url_filters": OP12,
    "op13_filter_audit": OP13,
}
