"""The corpus operators as registered queries over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import credentials, exact_dedup, langid, line_quality, mixing, packing, pii, sharding, simhash, telephony
from sigloom.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select(F.col("doc_id").alias("row_id"), "text", "lang"))
    return langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.as_media(table(spark, sf_dir, "documents"), telephony.DIGESTS)


_QUERIES = (
    op1_language_id, op2_exact_dedup, op3_best_fit_packing, op4_secret_scan, op5_source_mix, op6_personal_data,
    op7_sharding, op8_simhash_dedup, op9_line_quality, op10_telephony_audio, language_id_pages,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

SOURCE_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), q AS (
  SELECT *, 2 * source_size / weight AS level,
         sum(weight) OVER (ORDER BY 2 * source_size / weight DESC, source DESC NULLS FIRST) AS heavy,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM w
), r AS (
  SELECT first((budget - used)::DOUBLE / heavy ORDER BY level, source NULLS LAST)
         FILTER (level >= (budget - used)::DOUBLE / heavy) AS rate FROM q),
t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * rate) AS target FROM w CROSS JOIN r
), p AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER () AS id,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT p.*, r * source_size + before + least(size, (i + 1) * 128) AS upto, least(size, (i + 1) * 128) - i * 128 AS words
  FROM p, range(2) x(r), LATERAL (SELECT unnest(range(greatest(1, (size + 127) // 128))) AS i)
), s2 AS (
  SELECT *, sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN upto::DOUBLE / target ELSE 0 END, source NULLS LAST, upto, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM c
), b AS (SELECT floor(sum(target) + 0.001)::BIGINT AS budget FROM t)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(greatest(0, least(words, budget - (spent - words))))::BIGINT AS taken
FROM s2, b GROUP BY id
"""


def sharding_sql(shards: tuple[str, ...] = sharding.SHARDS, slots: int = sharding.SLOTS) -> str:
    """Fills the table by recursion, one claim a step, from the shards' names alone."""
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH RECURSIVE shards AS (SELECT unnest([{names}]) AS shard, unnest(range({len(shards)})) AS k),
walks AS (
  SELECT k, shard, ('0x' || substr(md5(shard), 1, 15))::BIGINT % {slots} AS o,
         ('0x' || substr(md5(shard), 16, 15))::BIGINT % {slots - 1} + 1 AS step FROM shards
), claims(turn, slot, taken) AS (
  SELECT -1::BIGINT, NULL::BIGINT, repeat('0', {slots})::BIT
  UNION ALL
  SELECT turn + 1, free, set_bit(taken, free::INT, 1)
  FROM (
    SELECT c.turn, c.taken,
           list_filter(list_transform(range({slots}), lambda j: (w.o + j * w.step) % {slots}), lambda x: get_bit(c.taken, x::INT) = 0)[1] AS free
    FROM claims c JOIN walks w ON w.k = (c.turn + 1) % {len(shards)}
    WHERE c.turn + 1 < {slots}
  )
), placed AS (SELECT slot, shard FROM claims JOIN walks ON walks.k = turn % {len(shards)} WHERE turn >= 0),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT d.doc_id, d.slot, placed.shard FROM d JOIN placed USING (slot)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_DEDUP_SQL, "op5_source_mix": SOURCE_MIX_SQL, "op7_sharding": sharding_sql()}
