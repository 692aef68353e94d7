"""Fan-in of everything known about a file, and audits of storage and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import first_filled

SEPARATOR = " | "


def folded(column: str) -> F.Column:
    """Distinct values that aren't blank, sorted, in one text."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")))), SEPARATOR)


def fan_in(base: DataFrame, key: str, branches: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """base with every branch's columns folded by key. Each branch (rows, its key, columns) is aggregated before it
    is joined, so branches never multiply each other."""
    for rows, own, columns in branches:
        agg = rows.groupBy(F.col(own).alias(key)).agg(*[folded(c).alias(c) for c in columns])
        base = base.join(agg, key, "left").na.fill("", columns)
    return base


def readiness(rows: DataFrame, needed: list[str]) -> DataFrame:
    """rows with the needed columns that are empty, in order of name, and whether none is."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in sorted(needed)])), "|")
    return rows.withColumn("missing_fields", missing).withColumn("parse_ready", missing == "")


def readiness_summary(rows: DataFrame) -> DataFrame:
    """One row: how many, how many ready, and their share."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("parse_ready").alias("n_ready")).withColumn("ready_rate", F.when(F.col("n_rows") > 0, F.col("n_ready") / F.col("n_rows")))


def missing_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("missing_fields <> ''").select(F.explode(F.split("missing_fields", r"\|")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def storage_audit(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """(key, issue) for assets (key, expected) against objects (key, actual): ok, missing or mismatch."""
    issue = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "mismatch").otherwise("ok")
    return assets.join(objects, "key", "left").select("key", "expected", "actual", issue.alias("issue"))


def audit_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count("*").alias("checked"), *[F.count_if(F.col("issue") == x).alias(x) for x in ("ok", "missing", "mismatch")],
        F.sum("expected").alias("expected_bytes"), F.coalesce(F.sum("actual"), F.lit(0)).alias("available_bytes"),
    )


def completeness(targets: DataFrame, audited: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Targets without an audited row, and those with one."""
    return targets.join(audited, key, "left_anti"), targets.join(audited, key, "left_semi")


def inventory(*legs: DataFrame) -> DataFrame:
    """The distinct ids of all legs."""
    out = legs[0]
    for leg in legs[1:]:
        out = out.union(leg)
    return out.distinct()


def drift(planned: DataFrame, approved: DataFrame) -> DataFrame:
    """Actions on one side only: none if the plan is still what was approved."""
    return planned.exceptAll(approved).withColumn("side", F.lit("planned")).unionByName(approved.exceptAll(planned).withColumn("side", F.lit("approved")))


# The columns of a parse manifest, in order, and its version.
MANIFEST_VERSION = "parse_manifest.v1"
OBJECT_FIELDS = ("manifest_schema_version", "bucket", "object_key", "nas_path", "sha256", "file_ext", "mime_type", "byte_size", "etag", "blob_created_at", "file_asset_count", "ingest_event_count")
SET_FIELDS = (
    "file_ids", "archive_ids", "file_names", "original_names", "resolved_provinces", "resolved_regions", "source_provinces", "source_cities", "region_codes", "archive_titles", "domain_types", "file_roles",
    "period_kinds", "publish_dates", "period_starts", "period_ends", "period_raws", "source_urls", "source_names", "source_ids", "task_ids", "batch_ids", "ingested_ats",
)
MANIFEST_FIELDS = (*OBJECT_FIELDS, *SET_FIELDS, "parse_ready", "missing_fields")


def _iso(at: Column) -> Column:
    """A time of a session in UTC as ISO text, with microseconds if it has any."""
    fraction = F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, "'.'SSSSSS")).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def parse_manifest(blobs: DataFrame, assets: DataFrame, events: DataFrame, tasks: DataFrame, mounts: DataFrame, archives: DataFrame, sources: DataFrame, regions: DataFrame, bucket: str = "cost-raw", nas_root: str = "", domain: str | None = None) -> DataFrame:
    """One row of MANIFEST_FIELDS, all text, for each stored object of the bucket: what its files, observations, tasks, archives and
    sources say about it, each as its distinct values in order.

    blobs: blob_hash, storage_bucket, blob_storage_key, mime_type, byte_size, etag, created_at; assets: file_id, blob_hash, file_name;
    events: event_id, file_id, task_id, source_id, original_name, source_url, batch_id, ingested_at; tasks: task_id, source_id, batch_id,
    period_start, period_end, period_raw; mounts: archive_id, file_id, file_role; archives: archive_id, title, region_code,
    domain_type, period_kind, publish_date, source_url, source_id, task_id, batch_id, period, period_start, period_end, period_raw; sources:
    source_id, name, province, city; regions: region_code, province_name, region_name. domain: only files that an archive of it holds.

    Observations and archives of a file would multiply each other in one join. Here each branch is folded by object before it is
    joined, a row for a row: no value becomes a row of its own. The source of a pair is that of the observation, else of its task, else of the archive; so
    archives name a source only for files with an observation that has none, or without any.
    """
    blobs = blobs.where(F.col("storage_bucket") == bucket)
    if domain is not None:
        archives = archives.where(F.col("domain_type") == domain)
        mounts = mounts.join(archives.select("archive_id"), "archive_id", "left_semi")
        assets = assets.join(mounts.select("file_id"), "file_id", "left_semi")
    assets = assets.join(blobs.select("blob_hash"), "blob_hash", "left_semi")
    if domain is not None:
        blobs = blobs.join(assets.select("blob_hash"), "blob_hash", "left_semi")
    of_file = assets.select("file_id", "blob_hash")
    done = tasks.select("task_id", F.col("task_id").alias("known_task"), F.col("source_id").alias("task_source"), F.col("batch_id").alias("task_batch"), "period_start", "period_end", "period_raw")
    told = events.select("file_id", "task_id", F.col("source_id").alias("event_source"), "original_name", "source_url", F.col("batch_id").alias("event_batch"), "ingested_at")
    told = told.join(done, "task_id", "left").withColumn("source", first_filled(F.col("event_source"), F.col("task_source")))
    of_source = sources.select(F.col("source_id").alias("source"), F.col("source_id").alias("known_source"), F.col("name").alias("source_name"), "province", "city")
    seen = told.join(of_file, "file_id").join(of_source, "source", "left")
    # The source of an archive counts for files with an observation that has none, or without any.
    sourced = told.groupBy("file_id").agg(F.bool_or(F.col("source").isNull()).alias("open"))
    held = mounts.join(of_file, "file_id").join(archives.withColumn("archive", F.col("archive_id")), "archive_id", "left").join(regions, "region_code", "left").join(sourced, "file_id", "left")
    held = held.withColumn("source", F.when(F.coalesce("open", F.lit(True)), first_filled(F.col("source_id")))).join(of_source, "source", "left")

    sets: dict[str, list[str]] = {f: [] for f in SET_FIELDS}

    def said(rows: DataFrame, branch: str, values: list[tuple[str, Column]]) -> DataFrame:
        """The distinct values of each column of a branch, by object; a field may have several columns."""
        found = []
        for k, (field, value) in enumerate(values):
            sets[field].append(f"{branch}_{k}")
            found.append(F.collect_set(F.nullif(F.trim(value.cast("string")), F.lit(""))).alias(f"{branch}_{k}"))
        return rows.groupBy("blob_hash").agg(*found)

    c = F.col
    by_source = [("source_names", c("source_name")), ("source_ids", c("known_source")), ("source_provinces", c("province")), ("source_cities", c("city"))]
    branches = [
        said(assets, "asset", [("file_ids", c("file_id")), ("file_names", c("file_name"))]),
        said(seen, "event", [
            ("original_names", c("original_name")), ("source_urls", c("source_url")), ("source_ids", c("event_source")), ("task_ids", c("task_id")), ("task_ids", c("known_task")), ("batch_ids", c("event_batch")), ("batch_ids", c("task_batch")),
            ("ingested_ats", _iso(c("ingested_at"))), ("period_starts", c("period_start")), ("period_ends", c("period_end")), ("period_raws", c("period_raw")), *by_source,
        ]),
        said(held, "archive", [
            ("file_roles", c("file_role")), ("archive_ids", c("archive")), ("archive_titles", c("title")), ("region_codes", c("region_code")), ("domain_types", c("domain_type")), ("period_kinds", c("period_kind")), ("publish_dates", c("publish_date")),
            ("source_urls", c("source_url")), ("source_ids", c("source_id")), ("task_ids", c("task_id")), ("batch_ids", c("batch_id")), ("period_starts", first_filled(c("period_start"), c("period"))), ("period_ends", c("period_end")), ("period_raws", first_filled(c("period_raw"), c("title"))),
            ("resolved_provinces", c("province_name")), ("resolved_regions", c("region_name")), *by_source,
        ]),
    ]
    for into, out_of in (("resolved_provinces", "source_provinces"), ("resolved_regions", "source_cities")):
        sets[into] += sets[out_of]
    files = assets.groupBy("blob_hash").agg(F.count_distinct("file_id").alias("files"))
    observed = events.select("event_id", "file_id").join(of_file, "file_id").groupBy("blob_hash").agg(F.count_distinct("event_id").alias("events"))
    rows = blobs
    for branch in (*branches, files, observed):
        rows = rows.join(branch, "blob_hash", "left")
    none = F.array().cast("array<string>")
    folded = [F.array_join(F.array_sort(F.array_distinct(F.concat(none, *[F.coalesce(x, none) for x in columns]))), SEPARATOR).alias(f) for f, columns in sets.items()]
    rows = rows.select(*blobs.columns, "files", "events", *folded)
    rows = rows.na.fill("", list(SET_FIELDS))
    lacks = lambda name, *fields: F.when(F.concat(*[F.col(f) for f in fields]) == "", name)
    missing = F.concat_ws("|", lacks("archive_ids", "archive_ids"), lacks("original_names", "original_names", "file_names"), lacks("period", "period_starts", "period_raws"), lacks("region", "resolved_regions", "region_codes"))
    key, text = c("blob_storage_key"), lambda x: F.coalesce(x.cast("string"), F.lit(""))
    path = F.concat(F.lit(nas_root.rstrip("/") + "/"), key) if nas_root else F.lit("")
    return rows.select(
        F.lit(MANIFEST_VERSION).alias("manifest_schema_version"), c("storage_bucket").alias("bucket"), key.alias("object_key"), path.alias("nas_path"), c("blob_hash").alias("sha256"), F.lower(F.regexp_extract(key, r"[^/](\.[^./]+)$", 1)).alias("file_ext"),
        text(c("mime_type")).alias("mime_type"), text(c("byte_size")).alias("byte_size"), text(c("etag")).alias("etag"), text(_iso(c("created_at"))).alias("blob_created_at"), F.coalesce("files", F.lit(0)).cast("string").alias("file_asset_count"), F.coalesce("events", F.lit(0)).cast("string").alias("ingest_event_count"),
        *SET_FIELDS, F.when(missing == "", "true").otherwise("false").alias("parse_ready"), missing.alias("missing_fields"),
    )
