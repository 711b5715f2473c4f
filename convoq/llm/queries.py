"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoq.llm import classifier, context_mixing, decontaminate, mixing, quality_rules, rans, secret_scan, simhash, suffix_dedup, turn_repair, url_filters, vector_file, wrappers
from convoq.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scored(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations"))))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vector_file.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_url_filters, op3_source_mixing, op4_quality_rules, op5_quality_classifier,
        op6_simhash_near_dedup, op7_secret_scans, op8_token_output, op9_html_extraction, op10_benchmark_decontamination,
        op11_conversation_repair, op12_lm_scoring, op13_hard_negatives,
    )
}

_WORDS = r"""list_filter(string_split_regex(translate(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '')"""
_GRAMS = "unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS g"

#: How a score moves along edges until what moves is settled: total is what a round moved in all.
_FLOW = """
{n}s AS (SELECT host, {seed} AS moved FROM hosts WHERE {seed} > 0),
{n}f AS (SELECT 0 AS r, host, moved, (SELECT sum(moved) FROM {n}s) AS total, (SELECT sum(moved) FROM {n}s) AS mass FROM {n}s
  UNION ALL SELECT r + 1, {to}, sum(share * moved * 0.85), sum(sum(share * moved * 0.85)) OVER (), any_value(mass)
    FROM {n}f JOIN (SELECT src, dst, n / sum(n) OVER (PARTITION BY {of}) AS share FROM links) e ON e.{of} = {n}f.host WHERE total > 1e-6 * mass AND r < 120 GROUP BY r, {to}),
{n} AS (SELECT host, sum(moved) AS score FROM {n}f GROUP BY host)"""
_RULED = r"""
u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
p0 AS (SELECT page_id, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
p1 AS (SELECT page_id, html, host, path, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/' WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/' WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM p0),
ruled AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given FROM p1),
hosts AS (SELECT host, CAST(count(*) FILTER (given = 'allow') AS DOUBLE) AS allowed, CAST(count(*) FILTER (given = 'block') AS DOUBLE) AS blocked, CAST(count(*) FILTER (given IS NULL) AS DOUBLE) AS unruled FROM ruled WHERE host <> '' GROUP BY host),
l0 AS (SELECT host AS src, list_distinct(list_transform(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS found FROM ruled),
l1 AS (SELECT src, unnest(found) AS dst FROM l0),
links AS (SELECT src, dst, count(*) AS n FROM l1 WHERE src <> dst AND src <> '' GROUP BY ALL)"""

#: Matches of the secrets' patterns; a pattern's n-th match starts after the n pieces before it and the n - 1 matches.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = (_ASSIGN, "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_-]{24,}")
_MATCHES = " UNION ALL ".join(f"SELECT r, {k} AS kind_no, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d" for k, p in enumerate(_SECRETS))
_SHARE_OF = "((length(value) - length(replace(value, ch, ''))) / length(value))"

#: Repeated windows, rules with link flow, containment, mixing and secrets can be said in SQL. The others are learned, hashed
#: or decoded; tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {
    # Every window of every document by its MD5.
    "op1_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(1, octet_length(b) - 198)) AS i, b FROM d),
k AS (SELECT r, i, md5_number(b[i:i + 199]) AS k FROM w),
a AS (SELECT r, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM a),
s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
spans AS (SELECT r, k, min(i) AS s, max(i) + 199 AS e FROM s GROUP BY r, k),
cut AS (SELECT r, k, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY k), 0) AS before FROM spans),
p AS (SELECT r, before + 1 AS x, s - 1 AS y, e - s + 1 AS gone FROM cut UNION ALL SELECT d.r, coalesce(max(e), 0) + 1, any_value(octet_length(b)), 0 FROM d LEFT JOIN spans ON spans.r = d.r GROUP BY d.r)
SELECT doc_id, any_value(octet_length(b)) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(coalesce(string_agg(CASE WHEN y >= x THEN hex(b[x:y]) ELSE '' END, '' ORDER BY x), ''))) AS kept_sha256
FROM p JOIN d USING (r) GROUP BY r, doc_id""",
    "op7_secret_scans": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
x AS ({_MATCHES}),
y AS (SELECT r, kind_no, ms, gs, unnest(ms) AS v, generate_subscripts(ms, 1) AS n FROM x WHERE len(ms) > 0),
z AS (SELECT r, kind_no, v, CASE WHEN kind_no = 0 THEN regexp_extract(v, '{_ASSIGN}', 2) ELSE v END AS value,
  CAST(list_sum(list_transform(gs[1:n], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda s: length(s))), 0) AS BIGINT) AS s FROM y),
base AS (SELECT r, kind_no, s, s + length(v) AS e, value FROM z WHERE kind_no < 3 AND (kind_no > 0 OR length(value) >= 12)),
c0 AS (SELECT r, kind_no, s, s + length(v) AS e, value, regexp_matches(value, '[a-z]') AS lo, regexp_matches(value, '[A-Z]') AS up, regexp_matches(value, '[0-9]') AS di, regexp_matches(value[2:], '[A-Z]') AS inner_up,
  list_sum(list_transform(list_distinct(string_split(value, '')), lambda ch: -{_SHARE_OF} * log2({_SHARE_OF}))) AS bits FROM z WHERE kind_no = 3),
cand AS (SELECT r, kind_no, s, e, value FROM c0 WHERE ((lo AND up AND di) OR (CASE WHEN lo <> up THEN di ELSE inner_up AND lo END AND regexp_matches(value, '[A-Za-z0-9]{{24,}}')))
  AND bits >= CASE WHEN regexp_full_match(value, '[0-9A-F]+|[0-9a-f]+') THEN 3.0 ELSE 3.5 END AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = c0.r AND base.s < c0.e AND base.e > c0.s)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
own AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) <= 3 AND count(DISTINCT t) <= 3 AS live FROM every JOIN d USING (r) GROUP BY value),
shown AS (SELECT r, kind_no, s, live, ['assign', 'access', 'hex', 'live'][kind_no + 1] || ':' || s || ':' || e AS span FROM every JOIN own USING (value) WHERE kind_no < 3 OR live)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex, sha256(coalesce(string_agg(span, ',' ORDER BY s, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, kind_no), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM d LEFT JOIN shown USING (r) GROUP BY r""",
    "op2_url_filters": "WITH RECURSIVE"
    + _RULED
    + ","
    + _FLOW.format(n="trust", seed="allowed", of="src", to="dst")
    + ","
    + _FLOW.format(n="distrust", seed="blocked", of="dst", to="src")
    + """,
v AS (SELECT host, coalesce(trust.score, 0) AS t, coalesce(distrust.score, 0) AS d, unruled FROM hosts LEFT JOIN trust USING (host) LEFT JOIN distrust USING (host))
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN d > 0 AND d >= 0.5 * (t + d + unruled) THEN 'block' END, 'allow') AS verdict, coalesce(t, 0) AS host_trust, coalesce(d, 0) AS host_distrust
FROM ruled LEFT JOIN v USING (host)""",
    "op10_benchmark_decontamination": f"""
WITH i0 AS (SELECT item_id, row_number() OVER () AS rid, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT *, least(5, len(words)) AS k FROM i0 WHERE len(words) > 0),
ish AS (SELECT DISTINCT * FROM (SELECT rid, item_id, k, {_GRAMS} FROM it)),
n AS (SELECT rid, count(*) AS n FROM ish GROUP BY rid),
dw AS (SELECT row_number() OVER () AS did, doc_id, {_WORDS} AS words FROM documents),
dsh AS (SELECT DISTINCT * FROM (SELECT did, k, {_GRAMS} FROM dw, (SELECT DISTINCT k FROM it) WHERE len(words) >= k)),
hits AS (SELECT did, rid, item_id, count(*) AS c FROM dsh JOIN ish USING (k, g) GROUP BY ALL),
ok AS (SELECT did, item_id, c / n AS share FROM hits JOIN n USING (rid) WHERE c >= ceil(0.8 * n - 1e-9))
SELECT doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id, share), '') AS item_ids, coalesce(max(share), 0) AS max_containment
FROM dw LEFT JOIN ok USING (did) GROUP BY did, doc_id""",
    # Levels are found by ordering sources by the level at which they are full, thresholds by ordering hashes.
    "op3_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || left(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)), 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w FROM s0),
s2 AS (SELECT *, 2.0 * source_size / w AS full_at, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS r FROM s1),
s3 AS (SELECT a.r, a.full_at, (1.5 * (SELECT sum(source_size) FROM s1) - coalesce((SELECT sum(2.0 * source_size) FROM s2 b WHERE b.r < a.r), 0)) / (SELECT sum(w) FROM s2 b WHERE b.r >= a.r) AS level FROM s2 a),
lv AS (SELECT level FROM s3 WHERE level < full_at * (1 - 1e-12) ORDER BY r LIMIT 1),
s4 AS (SELECT s2.source, source_size, CASE WHEN (SELECT level FROM lv) IS NULL OR (SELECT level FROM lv) * w >= 2.0 * source_size * (1 - 1e-12) THEN 2.0 * source_size ELSE (SELECT level FROM lv) * w END AS target FROM s2),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM s5),
hs AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
cu AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs),
ex AS (SELECT cu.source, cu.h, upto <= rest OR (upto - cu.size <= rest AND 2 * (rest - (upto - cu.size)) >= cu.size AND rest > 0) AS more FROM cu JOIN s6 ON cu.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, CAST(size * least(whole + CAST(more AS INT), 2) AS BIGINT) AS taken, d.source
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source JOIN ex ON d.source IS NOT DISTINCT FROM ex.source AND d.h = ex.h""",
    # Every anchor's score with every row.
    "op13_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    # From each conversation's last turn back: for each state (nothing, s, u, a) the least cost, its audit, its messages.
    "op11_conversation_repair": """
WITH RECURSIVE t0 AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations),
t1 AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, octet_length(b) + 1), lambda i: [CAST(('0x' || hex(b[i:i])) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS how FROM t0),
t2 AS (SELECT r, conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), r, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, trim(text, E' \t\n\x0B\x0C\r') AS core FROM t2),
t4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM t3),
t AS (SELECT *, core = '' AS blank, core <> '' AND again AS duplicate, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated FROM t4),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, any_value(n) AS n FROM t GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'm': []::VARCHAR[]} AS e, {'c': 4, 'a': 'II', 'm': ['user:', 'assistant:']} AS s, {'c': 2, 'a': 'I', 'm': ['assistant:']} AS u, {'c': 0, 'a': '', 'm': []::VARCHAR[]} AS a FROM k
  UNION ALL
  SELECT conv_id, i, e, s, u, a FROM (SELECT conv_id, i, list_min([e2, {'c': u2.c + 2, 'a': 'I' || u2.a, 'm': list_prepend('user:', u2.m)}]) AS e, list_min([s2, {'c': u2.c + 2, 'a': 'I' || u2.a, 'm': list_prepend('user:', u2.m)}]) AS s, u2 AS u, list_min([a2, {'c': u2.c + 2, 'a': 'I' || u2.a, 'm': list_prepend('user:', u2.m)}]) AS a
  FROM (SELECT conv_id, i, e1 AS e2, s1 AS s2, a1 AS a2, list_min([u1, {'c': a1.c + 2, 'a': 'I' || a1.a, 'm': list_prepend('assistant:', a1.m)}]) AS u2
  FROM (SELECT conv_id, i, e1, s1, u1, list_min([a1, {'c': u1.c + 2, 'a': 'I' || u1.a, 'm': list_prepend('user:', u1.m)}]) AS a1
  FROM (SELECT dp.conv_id, t.i,
    list_min([{'c': e.c + 3, 'a': 'D' || e.a, 'm': e.m}, {'c': u.c + cut + CASE WHEN f = 'u' THEN gone ELSE never END, 'a': 'K' || u.a, 'm': list_prepend(line, u.m)}, {'c': s.c + cut + CASE WHEN f = 's' THEN gone ELSE never END, 'a': 'K' || s.a, 'm': list_prepend(line, s.m)}, {'c': u.c + 2 + cut + gone, 'a': 'R' || u.a, 'm': list_prepend('user:' || text, u.m)}]) AS e1,
    list_min([{'c': s.c + 3, 'a': 'D' || s.a, 'm': s.m}, {'c': u.c + cut + CASE WHEN f = 'u' THEN gone ELSE never END, 'a': 'K' || u.a, 'm': list_prepend(line, u.m)}, {'c': u.c + 2 + cut + gone, 'a': 'R' || u.a, 'm': list_prepend('user:' || text, u.m)}]) AS s1,
    list_min([{'c': u.c + 3, 'a': 'D' || u.a, 'm': u.m}, {'c': a.c + cut + CASE WHEN f = 'a' THEN gone ELSE never END, 'a': 'K' || a.a, 'm': list_prepend(line, a.m)}, {'c': a.c + 2 + cut + gone, 'a': 'R' || a.a, 'm': list_prepend('assistant:' || text, a.m)}]) AS u1,
    list_min([{'c': a.c + 3, 'a': 'D' || a.a, 'm': a.m}, {'c': u.c + cut + CASE WHEN f = 'u' THEN gone ELSE never END, 'a': 'K' || u.a, 'm': list_prepend(line, u.m)}, {'c': u.c + 2 + cut + gone, 'a': 'R' || u.a, 'm': list_prepend('user:' || text, u.m)}]) AS a1
    FROM dp JOIN (SELECT *, role[1] AS f, role || ':' || text AS line, CAST(truncated AS INT) AS cut, CASE WHEN blank OR duplicate THEN 1000000 ELSE 0 END AS gone, 1000000 AS never FROM t) t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i - 1))))),
d AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.m, chr(10)), '')) AS repaired_sha256
FROM d LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM d.conv_id AND dp.i = 1""",
}
