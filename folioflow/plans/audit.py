"""Audit of where regions publish, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a source and its review can be.
SOURCE_STATUSES = ("auto_crawl_ready", "coverage_declaration", "source_blocked", "pending_verify", "missing_official_source")
REVIEW_STATUSES = ("draft", "reviewed", "accepted")
MANUAL_PATH = "017/manual_upload"


def clean(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def row_errors(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """(_line_number, target_region_code, errors) for each audit row that breaks a rule of its status."""
    required = regions.where("is_required").select(F.col("target_region_code").alias("__code")).distinct()
    joined = rows.join(required, clean("target_region_code") == F.col("__code"), "left")
    status, review = F.coalesce(clean("source_status"), F.lit("")), F.coalesce(clean("review_status"), F.lit("draft"))
    none = lambda *names: F.coalesce(*[clean(n) for n in names]).isNull()
    ready, blocked = status == "auto_crawl_ready", status == "source_blocked"
    rules = [
        (~status.isin(*SOURCE_STATUSES), "INVALID_SOURCE_STATUS"), (~review.isin(*REVIEW_STATUSES), "INVALID_REVIEW_STATUS"), (F.col("__code").isNull(), "UNKNOWN_TARGET_REGION_CODE"),
        (ready & none("site_id"), "AUTO_CRAWL_READY_SITE_ID_REQUIRED"), (ready & none("entry_url"), "AUTO_CRAWL_READY_ENTRY_URL_REQUIRED"),
        (ready & none("adapter_kind", "crawl_pattern"), "AUTO_CRAWL_READY_ADAPTER_OR_PATTERN_REQUIRED"),
        (blocked & none("blocked_reason", "audit_note"), "SOURCE_BLOCKED_REASON_REQUIRED"),
        (blocked & ~clean("manual_path").eqNullSafe(MANUAL_PATH), "SOURCE_BLOCKED_MANUAL_PATH_REQUIRED"),
        ((status == "coverage_declaration") & none("entry_url", "evidence_url"), "COVERAGE_DECLARATION_URL_REQUIRED"),
        ((status == "missing_official_source") & none("audit_note"), "MISSING_OFFICIAL_SOURCE_AUDIT_NOTE_REQUIRED"),
    ]
    errors = F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))
    return joined.select("_line_number", clean("target_region_code").alias("target_region_code"), errors.alias("errors")).where(F.size("errors") > 0)


def unaudited(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Required regions without an accepted row."""
    done = rows.where(clean("review_status") == "accepted").select("target_region_code")
    return regions.where("is_required").select("target_region_code").distinct().join(done, "target_region_code", "left_anti")


def summary(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: targets, audited ones, missing ones, rows with errors, and whether nothing is left to do."""
    targets = regions.where("is_required").agg(F.count_distinct("target_region_code").alias("targets"))
    missing, bad = unaudited(rows, regions).agg(F.count("*").alias("missing")), row_errors(rows, regions).agg(F.count("*").alias("invalid_rows"))
    out = targets.crossJoin(missing).crossJoin(bad)
    return out.select("targets", (F.col("targets") - F.col("missing")).alias("audited"), "missing", "invalid_rows", ((F.col("missing") == 0) & (F.col("invalid_rows") == 0)).alias("is_complete"))


def crawl_queue(rows: DataFrame) -> DataFrame:
    """Accepted sources that can be crawled, in the order in which they are."""
    ready = rows.where((clean("source_status") == "auto_crawl_ready") & (clean("review_status") == "accepted"))
    kept = ("province_code", "province_name", "target_region_code", "target_region_name", "site_id", "source_name", "adapter_kind", "crawl_pattern", "entry_url", "review_status")
    return ready.select(*[F.coalesce(clean(c), F.lit("")).alias(c) for c in kept]).orderBy("province_code", "target_region_code", "site_id")


def blocked(rows: DataFrame) -> DataFrame:
    """Blocked sources, why, and where their files come from instead."""
    reason = F.coalesce(clean("blocked_reason"), clean("audit_note"), F.lit("")).alias("blocked_reason")
    kept = ("province_code", "province_name", "target_region_code", "target_region_name", "site_id", "source_name", "entry_url", "manual_path")
    return rows.where(clean("source_status") == "source_blocked").select(*[F.coalesce(clean(c), F.lit("")).alias(c) for c in kept], reason).orderBy("province_code", "target_region_code", "site_id")


def pattern_counts(rows: DataFrame) -> DataFrame:
    """Crawlable sources by adapter and pattern."""
    ready = rows.where(clean("source_status") == "auto_crawl_ready")
    return ready.groupBy(*[F.coalesce(clean(c), F.lit("")).alias(c) for c in ("adapter_kind", "crawl_pattern")]).agg(F.count("*").alias("source_count")).orderBy("adapter_kind", "crawl_pattern")


def health(runs: DataFrame) -> DataFrame:
    """runs (run_id, file_rows, dead_letters, retries, failed) with health: critical where a run made file rows or gave
    tasks up, degraded where it retried or failed, else healthy."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return runs.withColumn("health", F.when(n("file_rows") | n("dead_letters"), "critical").when(n("retries") | n("failed"), "degraded").otherwise("healthy"))
