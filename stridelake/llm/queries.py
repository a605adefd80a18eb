"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import bpe, conversations, digest, exact_dedup, hard_negatives, html_text, license_scan, packing, piece_bpe, quality, simhash, token_counts, warc
from stridelake.llm.common import Scratch


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = Scratch(spark, "warc").path("archive")
    warc.archive_pages(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_digests(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_batches(_table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_simhash_near_dedup, op3_warc, op4_quality, op5_bpe_round_trip,
        op6_quartile_digest, op7_packing, op8_html_main_text, op9_token_counts, op10_exact_dedup,
        op11_hard_negatives, op12_conversation_repair, op13_piece_round_trip,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    # archives hold what the table holds: equality here is of whole payloads
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n from pages),
        g as (select h, max(page_id) m from p where n >= 1000 group by h)
        select page_id, n::bigint payload_bytes, sha1(p.h) payload_digest,
            case when m <> page_id then 'revisit' else 'response' end record_type,
            case when m <> page_id then m end refers_to
        from p left join g on p.h = g.h
    """,
    "op10_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
        select doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
            doc_id = max(doc_id) over w kept, sha256(t) text_sha256
        from d window w as (partition by t)
    """,
    "op11_hard_negatives": hard_negatives.oracle_sql(),
    "op12_conversation_repair": conversations.oracle_sql(),
}
