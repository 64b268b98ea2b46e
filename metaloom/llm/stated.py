"""What SQL can state of the operators' results: one whole result, and columns of others, taken from the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.fingerprint import op9_fingerprint
from metaloom.llm.mixing import op8_mix
from metaloom.llm.pii import op7_pii
from metaloom.llm.sharding import op10_shard
from metaloom.llm.urlfilter import op2_url_filter

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: All pairs of documents by their common shingles, and reachability.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = a"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 2: everything but the verdicts of the trees."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


URL_RULES = rf"""WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rule_verdict FROM v"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 8: everything but which documents are taken; and that none is taken more than twice."""
    found = op8_mix(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("bounded"))


#: Targets by filling sources in order of the level at which they are full.
MIX_TARGETS = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, cap / w AS full_at, coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER (ORDER BY cap / w DESC, place DESC) AS weights FROM w),
l AS (SELECT arg_min((total - caps) / weights, full_at) FILTER (WHERE (total - caps) / weights <= full_at) AS level FROM f)
SELECT doc_id, size, source_size, round(CASE WHEN level IS NULL THEN cap ELSE least(w * level, cap) END, 3) AS target, TRUE AS bounded FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, l"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 9: lengths and edited texts."""
    return op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", (F.col("fingerprint") == F.col("edited_fingerprint")).alias("same"))


EDITED_TEXTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next FROM documents),
e AS (SELECT doc_id, t, left(t, length(t) - length(t) // 2) || left(next, length(t) // 2) AS e FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, list_sort(string_split(t, chr(10))) = list_sort(string_split(e, chr(10))) AS same FROM e"""


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 10: sizes, and the rows and slots of each shard."""
    found = op10_shard(spark, sf_dir)
    sizes = found.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "size", F.lit(None).cast("bigint").alias("last_slot"))
    shards = found.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.max("slot").alias("last_slot"))
    return sizes.unionByName(shards.select(F.lit("shard").alias("kind"), F.col("shard").cast("bigint").alias("id"), "size", "last_slot"))


SHARD_SIZES = """WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'document' AS kind, doc_id AS id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS last_slot FROM documents
UNION ALL SELECT 'shard', j, n // 8 + CASE WHEN j < n % 8 THEN 1 ELSE 0 END, n // 8 + CASE WHEN j < n % 8 THEN 1 ELSE 0 END - 1 FROM n, range(8) r(j)"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 7: the numbers of base spans."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_COUNTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda m: reverse(regexp_replace(m, '[^0-9]', '', 'g'))) AS card, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g'))) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(list_filter(ip, lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 4) AS INTEGER), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(card, lambda c: length(c) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(c[i] AS INTEGER) WHEN CAST(c[i] AS INTEGER) > 4 THEN 2 * CAST(c[i] AS INTEGER) - 9 ELSE 2 * CAST(c[i] AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(phone, lambda n: n BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m"""

#: Every filter's failures, every order of the filters, and sums over the documents of each part.
FILTER_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id), m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, FALSE)} AS f FROM d JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM f GROUP BY ALL), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, good, toxic, n, o, step, o[step] AS x, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails FROM c, o, range(1, 6) r(step)),
e AS (SELECT *, list_contains(fails, x) AS here, len(list_filter(fails, lambda y: instr(o[1:step - 1], y) > 0)) > 0 AS earlier FROM s),
g AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, x, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND len(fails) = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (here AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost FROM e GROUP BY part, o, step, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""

#: Stretches of equal words at every lag, by pairs of equal words; those inside a stretch of a divisor's lag repeat something smaller.
PERIODIC_RUNS = r"""WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda crc, c: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, c)), 4294967295), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, w0, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a, h // 10 AS g FROM b),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM a),
p AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) >= greatest(12 - q, q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, arg_min({'start': start, 'length': length, 'period': q}, [-length, start, q]) AS top FROM r GROUP BY doc_id),
u AS (SELECT doc_id, list_distinct(flatten(list(range(start + q, start + length)))) AS dropped FROM r GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(p.w, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN (SELECT doc_id, unnest(dropped) AS i FROM u) z ON p.doc_id = z.doc_id AND p.i = z.i WHERE z.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period, (1000 * top.length // top.period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""

#: Windows of the items and of the documents as strings, joined.
DECONTAMINATE = rf"""WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, g.n, k FROM g JOIN i ON g.n = i.n AND g.x = i.x),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

QUERIES = {"url_rules": url_rules, "mix_targets": mix_targets, "edited_texts": edited_texts, "shard_sizes": shard_sizes, "pii_counts": pii_counts}
ORACLES = {"op3_near_duplicates": NEAR_DUPLICATES, "op11_filter_audit": FILTER_AUDIT, "op12_periodic_runs": PERIODIC_RUNS, "op13_decontaminate": DECONTAMINATE, "url_rules": URL_RULES, "mix_targets": MIX_TARGETS, "edited_texts": EDITED_TEXTS, "shard_sizes": SHARD_SIZES, "pii_counts": PII_COUNTS}
