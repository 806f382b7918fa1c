"""The registered queries of the corpus operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.llm import exactdedup, fingerprint, htmltext, langid, merkle, mixing, ngramjoin, packing, quality, recompression, toxicity, urlfilter, warc
from rollscan.llm.common import WORD, held_out, table

#: The rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.url_verdicts(pages, rules).drop("url")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, held_out(5, 0))
    scored = toxicity.score_documents(docs.select("doc_id", "text", held_out(5, 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(3, 1))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    return langid.predict(docs, langid.fit(docs, ~held_out(4, 2)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proofs(table(spark, sf_dir, "documents"), tampered)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.document_runs(table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_url_filter, op3_toxicity, op4_quality_rules, op5_warc_archives, op6_fingerprints, op7_exact_dedup, op8_ngram_jaccard_join, op9_language_id, op10_best_fit_packing, op11_merkle_manifest, op12_html_extraction, op13_periodic_runs)}


OP1 = f"""
WITH s AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, source,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents),
w AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey = 'n', skey) AS rk FROM s GROUP BY skey),
v AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM v WINDOW o AS (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE level <= cap::DOUBLE / weight ORDER BY cap::DOUBLE / weight, rk LIMIT 1),
t AS (SELECT skey, rk, source_size, least(cap::DOUBLE, coalesce((SELECT final FROM f) * weight, cap::DOUBLE)) AS target FROM v),
b AS (
  SELECT rk, blocks, least(3 * blocks, floor(target * blocks / source_size + 0.5))::BIGINT AS slots
  FROM (SELECT *, (source_size + 63) // 64 AS blocks FROM t WHERE source_size > 0)),
j AS (SELECT rk, blocks, unnest(range(0, slots)) AS slot FROM b),
z AS (SELECT greatest(1, ceil(count(*) / 4096::DOUBLE))::BIGINT AS shards FROM j),
g AS (SELECT rk, blocks, ('0x' || substr(md5('1:draw:' || rk || ':' || slot), 1, 15))::BIGINT % (SELECT shards FROM z) AS shard, count(*) AS drawn FROM j GROUP BY ALL),
k AS (SELECT rk, blocks, shard, unnest(range((upto - drawn)::BIGINT, upto::BIGINT)) AS slot FROM (SELECT *, sum(drawn) OVER (PARTITION BY rk ORDER BY shard) AS upto FROM g)),
h AS (SELECT *, ceil(sqrt(blocks))::BIGINT AS a, '1:' || rk || ':' || (slot // blocks) || ':' AS salt FROM k),
i AS (SELECT *, (blocks + a - 1) // a AS b, CASE WHEN blocks < 4096 THEN a * ((blocks + a - 1) // a) - blocks ELSE 15 END AS steps FROM h),
p AS (
  SELECT rk, shard, list_reduce(list_prepend(slot % blocks, range(0, steps + 1)), lambda x, i: CASE WHEN i > 0 AND x < blocks THEN x ELSE
    list_reduce(list_prepend(x, range(0, 4)), lambda y, j: CASE WHEN j % 2 = 0
      THEN (y % a + ('0x' || substr(md5(salt || j || ':' || (y // a)), 1, 12))::BIGINT) % a + y // a * a
      ELSE y % a + (y // a + ('0x' || substr(md5(salt || j || ':' || (y % a)), 1, 12))::BIGINT) % b * a END) END) AS block FROM i),
n AS (SELECT rk, block, shard, count(*) AS takes FROM p GROUP BY ALL),
d AS (
  SELECT s.*, t.rk, t.source_size, t.target, (((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648) * 1103515245) % 2147483648 AS scattered
  FROM s JOIN t USING (skey)),
q AS (
  SELECT *, (coalesce(sum(size) OVER (PARTITION BY rk ORDER BY scattered, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first,
         row_number() OVER () AS id FROM d),
x AS (SELECT id, rk, first, size, unnest(range(first // 64, (first + size - 1) // 64 + 1)) AS block FROM q WHERE size > 0),
y AS (
  SELECT id, shard, sum(takes * (least((block + 1) * 64 - first, size) - greatest(block * 64 - first, 0))) AS words
  FROM x JOIN n USING (rk, block) GROUP BY ALL),
e AS (SELECT id, sum(words)::BIGINT AS taken, count(*)::BIGINT AS shards FROM y GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, 0)::BIGINT AS shards, source FROM q LEFT JOIN e USING (id)
"""

OP2 = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r (rhost, rpath, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT page_id, host, path, arg_min(rule, (-length(rule), rule)) AS rule, arg_min(action, (-length(rule), rule)) AS verdict FROM m GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""

OP7 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


#: CRC-32 of doc_id as text, as `checksums` (doc_id, h).
CRC32 = """
crc AS (
  SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM range(0, 256) r(n)),
checksums AS (
  SELECT doc_id, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda j: ascii(s[j])::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256))) AS h
  FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL), crc)"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
OP11 = f"""
WITH RECURSIVE {CRC32},
d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, '') AS key, {" || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
         CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents LEFT JOIN checksums USING (doc_id)),
h AS (SELECT id, doc_id, key, sha256(head || {_FIELD("text")}) AS leaf, sha256(head || {_FIELD("changed")}) AS now FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM h),
s (lvl, key, idx, n, node) AS (
  SELECT 0, key, idx, n, leaf FROM l
  UNION ALL
  SELECT any_value(lvl) + 1, key, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM s WHERE n > 1 GROUP BY key, idx // 3),
b AS (SELECT key, node AS subroot, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM s WHERE n = 1),
u (lvl, idx, n, node) AS (
  SELECT 0, idx, n, subroot FROM b
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY idx // 3),
sr AS (SELECT lvl, key, idx // 3 AS run, list(node ORDER BY idx) AS ns FROM s WHERE n > 1 GROUP BY ALL),
ur AS (SELECT lvl, idx // 3 AS run, list(node ORDER BY idx) AS ns FROM u WHERE n > 1 GROUP BY ALL),
p (id, lvl, key, idx, node, proof) AS (
  SELECT id, 0, key, idx, now, '' FROM l
  UNION ALL
  SELECT id, p.lvl + 1, p.key, idx // 3, sha256(array_to_string(ns[:idx % 3], '') || node || array_to_string(ns[idx % 3 + 2:], '')),
         proof || array_to_string(ns[:idx % 3], '') || array_to_string(ns[idx % 3 + 2:], '')
  FROM p JOIN sr ON sr.lvl = p.lvl AND sr.key = p.key AND sr.run = p.idx // 3),
o AS (SELECT id, any_value(key) AS key, arg_max(node, lvl) AS node, arg_max(proof, lvl) AS proof FROM p GROUP BY id),
v (id, lvl, idx, node, proof) AS (
  SELECT id, 0, b.idx, node, proof FROM o JOIN b USING (key)
  UNION ALL
  SELECT id, v.lvl + 1, idx // 3, sha256(array_to_string(ns[:idx % 3], '') || node || array_to_string(ns[idx % 3 + 2:], '')),
         proof || array_to_string(ns[:idx % 3], '') || array_to_string(ns[idx % 3 + 2:], '')
  FROM v JOIN ur ON ur.lvl = v.lvl AND ur.run = v.idx // 3),
e AS (SELECT id, arg_max(node, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM v GROUP BY id),
r AS (SELECT node AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN b USING (key) JOIN e USING (id), r
"""

#: What the method finds on these pages, told by their article elements.
OP12 = r"""
WITH a AS (SELECT page_id, url, str_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(?:h1|p)>') AS parts FROM pages),
t AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS lines FROM a)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, length(coalesce(array_to_string(lines, chr(10)), ''))::BIGINT AS n_chars FROM t
"""

OP13 = f"""
WITH {CRC32},
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws, h FROM documents LEFT JOIN checksums USING (doc_id)),
g AS (SELECT id, doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN h // 10 % len(ws) ELSE len(ws) END AS a, h // 10 AS g FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM g),
i AS (SELECT id, unnest(range(0, n)) AS pos, unnest(list_transform(range(0, n), lambda x: ws[(CASE WHEN x < a THEN x ELSE a + (x - a) % p END) + 1])) AS word FROM f),
q AS (SELECT id, n, unnest(range(1, n // 4 + 1)) AS p FROM g),
c AS (SELECT id, p, unnest(range(0, n - p, p)) AS pos FROM q),
m AS (SELECT id, p, pos FROM c JOIN i x USING (id, pos) JOIN i y ON y.id = c.id AND y.pos = c.pos + p AND y.word = x.word),
k AS (
  SELECT DISTINCT id, p FROM (
    SELECT *, lead(pos) OVER w AS second, lead(pos, 2) OVER w AS third FROM m WINDOW w AS (PARTITION BY id, p ORDER BY pos))
  WHERE second = pos + p AND third = pos + 2 * p),
e AS (
  SELECT k.id, k.p, x.pos, x.pos - row_number() OVER (PARTITION BY k.id, k.p ORDER BY x.pos) AS island
  FROM k JOIN i x ON x.id = k.id JOIN i y ON y.id = k.id AND y.pos = x.pos + p AND y.word = x.word),
s AS (SELECT id, p, min(pos) AS start, count(*) + p AS length FROM e GROUP BY id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT id, start, length, min(p) AS period FROM s GROUP BY ALL),
z AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS pos FROM r),
l AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS kept FROM i ANTI JOIN z USING (id, pos) GROUP BY id),
t AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY id),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (id) LEFT JOIN l USING (id) LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": OP1, "op2_url_filter": OP2, "op5_warc_archives": OP5, "op7_exact_dedup": OP7, "op11_merkle_manifest": OP11, "op12_html_extraction": OP12, "op13_periodic_runs": OP13}
