"""Queries over the driver's tables, each the digest of its operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import decontam, golay, htmltext, langid, linededup, mixing, mixlm, sharding, syncmers, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edit(table(spark, sf_dir, "documents"))


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op8_positional_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other result of operator 8: documents that quote an item nearly."""
    return decontam.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
agg AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM agg),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, source_size * 3 AS most FROM ranked),
ratios AS (SELECT *, most::DOUBLE / weight::DOUBLE AS ratio FROM weighed),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM ratios WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, room::DOUBLE / rest::DOUBLE AS level FROM filled),
capped AS (SELECT *, ratio <= level AS full_up FROM levels),
shared AS (SELECT level FROM capped WHERE NOT full_up ORDER BY ratio, place LIMIT 1),
plan AS (
  SELECT source, source_size,
    CASE WHEN full_up THEN most::DOUBLE ELSE weight::DOUBLE * (SELECT level FROM shared) END AS target,
    CASE WHEN source_size = 0 THEN 0.0 WHEN full_up THEN 3.0 ELSE weight::DOUBLE * (SELECT level FROM shared) / source_size::DOUBLE END::DOUBLE AS rate
  FROM capped),
drawn AS (
  SELECT doc_id, size, source_size, target, rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, chr(0) || 'null') || ':' || digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM drawn
"""

OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT AS text_bytes,
    ('0x' || substr(md5('arrival:' || coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
feeds AS (SELECT source, greatest(ceil(sum(text_bytes) / 4194304.0), 1)::BIGINT AS slices FROM sized GROUP BY source),
starts AS (
  SELECT *, coalesce(sum(slices) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM feeds),
placed AS (
  SELECT doc_id, text_bytes, printf('arrival-0-%05d', (first + floor(u * slices))::BIGINT) AS arrival
  FROM sized JOIN starts ON sized.source IS NOT DISTINCT FROM starts.source),
small AS (SELECT arrival, count(*) AS n, sum(text_bytes)::BIGINT AS bytes FROM placed GROUP BY arrival),
tiers AS (SELECT *, TIER(bytes) AS tier FROM small),
runs AS (
  SELECT *, coalesce(sum(CASE WHEN bytes < 67108864 THEN bytes ELSE 0 END) OVER (
    PARTITION BY tier ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 67108864 AS run FROM tiers),
merged AS (
  SELECT *, bytes < 67108864 AND sum((bytes < 67108864)::INT) OVER (PARTITION BY tier, run) > 1 AS merge FROM runs),
named AS (SELECT *, CASE WHEN merge THEN printf('run-%d-%05d', tier, run::BIGINT) ELSE arrival END AS shard FROM merged),
shards AS (SELECT shard, sum(n)::BIGINT AS shard_rows, sum(bytes)::BIGINT AS shard_bytes FROM named GROUP BY shard)
SELECT doc_id, text_bytes, shard, TIER(shard_bytes) AS tier, shard_rows, shard_bytes
FROM placed JOIN named USING (arrival) JOIN shards USING (shard)
"""
_TIER = "(" + " + ".join(f"({{0}} >= {65536 * 4**k})::INT" for k in range(1, 9)) + ")"
OP7_SQL = OP7_SQL.replace("TIER(bytes)", _TIER.format("bytes")).replace("TIER(shard_bytes)", _TIER.format("shard_bytes"))

OP8_SQL = r"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS id, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT id, least(n, 13) AS l, array_to_string(w[s : s + least(n, 13) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(n - 13, 0) + 2)) AS s FROM items)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM docs, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l),
met AS (
  SELECT p.r, p.l, p.s, x.id FROM (SELECT r, l, s, array_to_string(w[s : s + l - 1], ' ') AS gram FROM places) p JOIN windows x USING (l, gram)),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS pos FROM (SELECT DISTINCT r, s, l FROM met)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1 AND max(page_id) IS NOT NULL),
r AS (SELECT p.*, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (d))
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

QUERIES = {"op1_minhash_lines": op1_minhash_lines, "op2_mixing": op2_mixing, "op3_page_differencing": op3_page_differencing, "op4_warc_normaliser": op4_warc_normaliser, "op5_golay_simhash": op5_golay_simhash, "op6_closed_syncmers": op6_closed_syncmers, "op7_size_tiered_shards": op7_size_tiered_shards, "op8_positional_decontam": op8_positional_decontam, "op9_context_mixing": op9_context_mixing, "op10_ppm_language": op10_ppm_language, "near_positional_decontam": proximity_matches}
ORACLES = {"op2_mixing": OP2_SQL, "op4_warc_normaliser": OP4_SQL, "op7_size_tiered_shards": OP7_SQL, "op8_positional_decontam": OP8_SQL}
