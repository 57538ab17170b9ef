"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table
from .conversations import repair_conversations
from .fingerprints import fingerprints
from .langid import language_id
from .mixing import document_sizes, mix
from .neardup import near_duplicates
from .negatives import hard_negatives
from .pieces import encode_and_decode
from .pii import replace_entities
from .quality import quality_rules
from .substrings import remove_repeats
from .suffixes import remove_repeated_bytes
from .toxicity import toxicity
from .warc import warc_round_trip


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(document_sizes(table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_warc, op4_language_id, op5_mixing, op6_pii, op7_sentencepiece, op8_fingerprints, op9_substring_dedup, op10_minhash_near_dedup, op11_hard_negatives, op12_conversation_repair, op13_suffix_array_dedup)}

ORACLES = {
    "op1_quality_rules": oracles.quality(),
    "op9_substring_dedup": oracles.REPEATS,
    "op10_minhash_near_dedup": oracles.NEAR,
    "op11_hard_negatives": oracles.HARD,
    "op13_suffix_array_dedup": oracles.BYTES,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM f""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
        c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS everything FROM s),
        f AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                     <= w * (everything - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM c),
        t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE w * ((everything - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN filled THEN 0 ELSE w END) OVER ()) END AS target FROM f),
        b AS (SELECT *, round(target)::BIGINT AS budget FROM t),
        r AS (SELECT d.doc_id, d.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs, b.budget,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM r""",
}
