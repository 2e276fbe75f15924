"""The registered query of each text operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.llm import (
    decontaminate,
    filter_audit,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    quality_crf,
    quality_rules,
    secret_scan,
    suffix_dedup,
    token_align,
    token_counts,
    url_filter,
)
from tiercraft.llm.text import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = mixing.copies(docs)
    return counted.select("doc_id", "size", "source_size", "target",
                          (F.col("copies") * F.col("size")).alias("taken"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_crf.score_documents(docs, model).select(
        "doc_id", (quality_crf.fold("doc_id") == 2).alias("held_out"), "score",
        (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.link_documents(docs, words=3, similarity=0.85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return (url_filter.filter_urls(pages, url_filter.rule_table(spark))
            .select("page_id", "host", "path", "rule", "verdict"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii_spans")
    return pii.find_pii(docs).select(
        "doc_id", *[pii.count_kind(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(pii.base_only(spans)), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    spans = F.col("secrets")
    return secret_scan.find_secrets(docs).select(
        "doc_id", *[secret_scan.count_kind(spans, k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.joined(secret_scan.base_only(spans)), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["verdict"] == "owned")).cast("long").alias("n_owned"),
        F.size(F.filter(spans, lambda s: s["verdict"] == "example")).cast("long").alias("n_example"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(filter_audit.judge(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality_rules, op3_line_dedup, op4_mix, op5_decontaminate, op6_token_counts, op7_quality,
    op8_near_dedup, op9_url_filter, op10_pii, op11_secrets, op12_token_align, op13_filter_audit)}
