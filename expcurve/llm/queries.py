"""The queries of this package: each applies one operator to its whole table.

``oracle_sql`` has DuckDB SQL where SQL can express the result; the others are
held against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expcurve.llm import (interactions, itq, packing, periodic, perspectives, rules, sharding, simhash, suffixes, tiling,
                          toxicity, warc, wrappers)
from expcurve.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (warc.archive_round_trip(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.transform("masks", lambda m: F.concat_ws(":", m["chars"].cast("string"), m["mask"].cast("string")))
    return perspectives.render(table(spark, sf_dir, "conversations")).withColumn("masks", F.array_join(masks, " "))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic.digest(periodic.periodic_runs(docs))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_simhash, op2_packing, op3_decontamination, op4_warc, op5_sharding, op6_suffixes, op7_rules,
        op8_toxicity, op9_embeddings, op10_chat, op11_periodic, op12_interactions,
        op13_html)}


ORACLE = {
    "op10_chat": """
        WITH t AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker, nameless, body) - 1 AS n
          FROM (
            SELECT conv_id, turn, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS part,
                   coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, role IS NULL AS nameless
            FROM conversations)),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE NOT nameless AND speaker <> 'system'),
        r AS (
          SELECT t.*, p.perspective, t.speaker = p.perspective AND NOT nameless AS own
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        h AS (
          SELECT *, CASE WHEN own THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
                         ELSE '<|user name=' || speaker || '|>' END AS header
          FROM r)
        SELECT conv_id, perspective, part, n // 256 AS piece, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg(header || body || '<|end|>' || chr(10), '' ORDER BY n) AS text,
               string_agg(length(header) || ':0 ' || (length(body) + 8) || ':' || own::INT, ' ' ORDER BY n) AS masks
        FROM h GROUP BY conv_id, perspective, part, n // 256""",
    "op12_interactions": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
        w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
        first AS (SELECT body, min(doc_id) AS first_id FROM d GROUP BY body),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
        m AS (
          SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::INT
                 + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask,
                 (good.doc_id IS NOT NULL)::INT AS good, (toxic.doc_id IS NOT NULL)::INT AS toxic
          FROM w JOIN first USING (body) LEFT JOIN good ON good.doc_id = w.doc_id LEFT JOIN toxic ON toxic.doc_id = w.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
          SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
                 [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (
          SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (
          SELECT part, filter_order, step, own,
                 sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM c, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
