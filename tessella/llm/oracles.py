"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
rep AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY r),
s AS (SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_share, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share,
  n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_share, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word FROM s),
step AS (SELECT t, ([1.0, 0.5, 0.3, 0.2, 0.1, 0.05]::DOUBLE[])[t] AS c1, ([0.9, 0.7, 0.5, 0.3, 0.2, 0.1]::DOUBLE[])[t] AS c2, ([0.25, 0.2, 0.15, 0.1, 0.05, 0.05]::DOUBLE[])[t] AS c3, ([40.0, 25.0, 18.0, 14.0, 12.0, 12.0]::DOUBLE[])[t] AS c4 FROM range(1, 7) x(t)),
good AS (SELECT v.r FROM v JOIN labels ON labels.doc_id = v.doc_id AND quality = 1 WHERE NOT base_failed),
cnt AS (SELECT lang, t, count(*) AS n, count(*) FILTER (symbol_share > c1 OR dup_line_share > c2 OR repeat_share > c3 OR mean_word > c4) AS k FROM v JOIN good USING (r), step GROUP BY ALL),
sure AS (SELECT *, k < 0.04 * n AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln(0.04) + (n - j) * ln(0.96)))) <= 0.05 / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM cnt) AS ok FROM cnt),
lim AS (SELECT lang, coalesce(min(t) FILTER (NOT ok) - 1, max(t)) AS t FROM sure GROUP BY lang),
bad AS (SELECT r, array_to_string(list_filter([CASE WHEN symbol_share > c1 THEN 'symbol_share' END, CASE WHEN dup_line_share > c2 THEN 'dup_line_share' END, CASE WHEN repeat_share > c3 THEN 'repeat_share' END, CASE WHEN mean_word > c4 THEN 'mean_word' END], lambda x: x IS NOT NULL), ',') AS b
  FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang JOIN step USING (t) WHERE symbol_share > c1 OR dup_line_share > c2 OR repeat_share > c3 OR mean_word > c4)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(b, '') AS broken_rules, NOT base_failed AND b IS NULL AS kept FROM v LEFT JOIN bad USING (r)"""

_OP3 = r"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(v, length(r.h || r.p)) AS verdict FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)"""

_OP5 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2 AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w::DOUBLE, source NULLS FIRST) AS k FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM o) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / ((SELECT sum(w) FROM o) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN CAST(cap AS DOUBLE) ELSE f.level * w END AS target FROM l, f),
q AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d WHERE size > 0),
v AS (SELECT doc_id, size, turn, (upto + turn * source_size) / target AS finish FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) x(turn) WHERE target > 0),
c AS (SELECT doc_id, count(*) AS copies FROM (SELECT doc_id, sum(size) OVER (ORDER BY finish, doc_id, turn ROWS UNBOUNDED PRECEDING) AS run FROM v) WHERE run <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(copies, 0) * size AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c USING (doc_id)"""

_OP10 = r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i AS first, lead(i, 2) OVER n AS last, x || chr(10) || lead(x) OVER n || chr(10) || lead(x, 2) OVER n AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW n AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS r FROM w WHERE k IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN later ON l.doc_id = later.doc_id AND l.i BETWEEN later.first AND later.last),
g AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN g USING (doc_id)"""

_OP11 = r"""WITH RECURSIVE e(i, v) AS (SELECT i, i::BIGINT FROM range(256) t(i)),
tab AS (SELECT list((SELECT list_reduce(list_prepend(v, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) ORDER BY i) AS t FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda x: coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-')) AS f,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS crc FROM documents, tab),
leaf AS (SELECT doc_id, lang, r, sha256(array_to_string(f, '')) AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN
  sha256(array_to_string(list_concat(f[1:3], [CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR)], f[5:5]), '')) ELSE sha256(array_to_string(f, '')) END AS held FROM d),
lv(lang, k, l) AS (SELECT lang, 0, list(leaf ORDER BY r) FROM leaf GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range(0, len(l), 2), lambda i: sha256(array_to_string(l[i + 1:i + 2], ''))) FROM lv WHERE len(l) > 1),
sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM lv WHERE len(l) = 1),
uv(k, l) AS (SELECT 0, list(subroot ORDER BY r) FROM sub
  UNION ALL SELECT k + 1, list_transform(range(0, len(l), 2), lambda i: sha256(array_to_string(l[i + 1:i + 2], ''))) FROM uv WHERE len(l) > 1),
st AS (SELECT doc_id, k, r >> k AS p, l FROM leaf JOIN lv ON leaf.lang IS NOT DISTINCT FROM lv.lang WHERE len(l) > 1
  UNION ALL SELECT doc_id, 1000 + k, sub.r >> k, l FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, uv WHERE len(l) > 1),
pf AS (SELECT doc_id, list((CASE WHEN p % 2 = 1 THEN 'L' WHEN p + 1 < len(l) THEN 'R' ELSE '-' END) || coalesce(l[1 + xor(p, 1)], '') ORDER BY k) AS s FROM st GROUP BY doc_id),
o AS (SELECT doc_id, leaf, subroot, (SELECT l[1] FROM uv WHERE len(l) = 1) AS root, sha256(coalesce(array_to_string(list_transform(s, lambda x: x[2:]), ''), '')) AS proof_sha256,
  list_reduce(list_prepend(held, coalesce(s, [])), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN pf USING (doc_id))
SELECT *, folded_root = root AS verified FROM o"""

_OP13 = r"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 20"""

ORACLES: dict[str, str] = {"op1_quality_rules": _OP1, "op3_url_filters": _OP3, "op5_source_mix": _OP5, "op10_line_dedup": _OP10, "op11_merkle_manifest": _OP11, "op13_exact_top_k": _OP13}
