"""Integrity of files against blobs, sources and the object store, and what became of every observation of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples that a report shows of each problem.
SAMPLES = 10


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def checked(assets: DataFrame, blobs: DataFrame, objects: DataFrame) -> DataFrame:
    """assets (file_id, blob_hash, sha256, file_size, bucket, object_key) with blob_state (none, orphan, conflict, ok) and
    object_state (none, missing, size_mismatch, ok). blobs: blob_hash, byte_size, bucket, object_key, each hash once; objects:
    bucket, object_key, byte_size as listed, each key once. A null size, bucket or key conflicts with nothing."""
    return object_states(blob_states(assets, blobs), objects)


def blob_states(assets: DataFrame, blobs: DataFrame) -> DataFrame:
    """assets with blob_state."""
    b = blobs.select("blob_hash", F.col("byte_size").alias("b_size"), F.col("bucket").alias("b_bucket"), F.col("object_key").alias("b_key"), F.lit(True).alias("b"))
    differs = (F.col("b_size") != F.col("file_size")) | (F.col("b_bucket") != F.col("bucket")) | (F.col("b_key") != F.col("object_key"))
    blob = F.when(~_filled("blob_hash"), "none").when(F.col("b").isNull(), "orphan").when(differs, "conflict").otherwise("ok")
    return assets.join(b, "blob_hash", "left").select(*assets.columns, blob.alias("blob_state"))


def object_states(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """assets with object_state."""
    o = objects.select("bucket", "object_key", F.col("byte_size").alias("o_size"), F.lit(True).alias("o"))
    place = F.when(~_filled("object_key"), "none").when(F.col("o").isNull(), "missing").when(~F.col("o_size").eqNullSafe(F.col("file_size")), "size_mismatch").otherwise("ok")
    return assets.join(o, ["bucket", "object_key"], "left").select(*assets.columns, place.alias("object_state"))


def same_content(assets: DataFrame) -> DataFrame:
    """(sha256, files, size_variants, bucket_variants, key_variants) of content that several files have."""
    variants = [F.count_distinct(c).alias(n) for c, n in (("file_size", "size_variants"), ("bucket", "bucket_variants"), ("object_key", "key_variants"))]
    return assets.where(_filled("sha256")).groupBy("sha256").agg(F.count("*").alias("files"), *variants).where("files > 1")


def of_domain(assets: DataFrame, events: DataFrame, sources: DataFrame, domain: str) -> DataFrame:
    """Files observed from sources of a domain, once for each observation."""
    wanted = sources.where(F.col("data_domain") == domain).select("source_id", F.col("name").alias("source_name"))
    return assets.join(events.select("file_id", "source_id").join(wanted, "source_id"), "file_id")


def sections(assets: DataFrame, blobs: DataFrame, objects: DataFrame, events: DataFrame, sources: DataFrame, domain: str = "quota") -> DataFrame:
    """(section, measure, n): how many files there are; their blob hashes; their digests; content that several have, and how
    often with other sizes or buckets; blobs that differ; files of a domain; whether every hash has its blob, as a foreign key
    would have it; and the state of every file's object."""
    n, length = F.count_if, F.length("sha256")
    # The two states rest on one join each, so each is counted on its own with no more columns than it needs.
    of_blob = blob_states(assets.select("blob_hash", "file_size", "bucket", "object_key"), blobs).agg(n(F.col("blob_state").isin("ok", "conflict")).alias("blob_exists"), n(F.col("blob_state") == "orphan").alias("blob_orphan"), n(F.col("blob_state") == "conflict").alias("blob_conflict"))
    of_object = object_states(assets.select("file_size", "bucket", "object_key"), objects).agg(n(F.col("object_state") == "ok").alias("exists_ok"), n(F.col("object_state") == "missing").alias("missing"), n(F.col("object_state") == "size_mismatch").alias("size_mismatch"))
    own = assets.agg(
        F.count("*").alias("total"), n(_filled("blob_hash")).alias("blob_hash_set"), n(~_filled("blob_hash")).alias("blob_hash_null"), n(_filled("object_key")).alias("with_object_key"),
        n(~_filled("sha256")).alias("sha256_empty"), n(length == 64).alias("sha256_length_64"), n(_filled("sha256") & (length < 64)).alias("sha256_short"),
    )
    # Several sizes are a least and a greatest that differ: no distinct values are gathered, nor rows of one content sorted.
    same = assets.where(_filled("sha256")).groupBy("sha256", "bucket").agg(F.count("*").alias("files"), F.min("file_size").alias("least"), F.max("file_size").alias("most"))
    same = same.groupBy("sha256").agg(F.sum("files").alias("files"), F.min("least").alias("least"), F.max("most").alias("most"), F.count("bucket").alias("buckets")).where("files > 1")
    groups = same.agg(F.count("*").alias("duplicate_sha_groups"), n((F.col("least") != F.col("most")) | (F.col("buckets") > 1)).alias("conflict_groups"))
    files = of_domain(assets, events, sources, domain).agg(F.count("*").alias("files"))
    one = own.crossJoin(of_blob).crossJoin(of_object).crossJoin(groups).crossJoin(files).withColumn("holds", (F.col("blob_orphan") == 0).cast("int"))
    parts = {
        "file_asset": ["total"], "blob_hash": ["blob_hash_set", "blob_hash_null", "blob_exists", "blob_orphan"], "sha256": ["sha256_empty", "sha256_length_64", "sha256_short"], "same_sha256": ["duplicate_sha_groups", "conflict_groups"],
        "blob_metadata": ["blob_conflict"], "domain_files": ["files"], "foreign_key": ["holds"], "objects": ["with_object_key", "exists_ok", "missing", "size_mismatch"],
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for section, columns in parts.items() for c in columns])))


def samples(assets: DataFrame, blobs: DataFrame, objects: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n files, by id, of each problem: a limit is what a sample is."""
    problems = F.array_compact(F.array(F.when(F.col("blob_state") == "orphan", "blob_orphan"), F.when(F.col("blob_state") == "conflict", "blob_conflict"), F.when(F.col("object_state").isin("missing", "size_mismatch"), F.col("object_state"))))
    rows = checked(assets, blobs, objects).select("*", F.explode(problems).alias("problem"))
    out = None
    for problem in ("blob_orphan", "blob_conflict", "missing", "size_mismatch"):
        some = rows.where(F.col("problem") == problem).orderBy("file_id").limit(n)
        out = some if out is None else out.unionByName(some)
    return out


def observations(candidates: DataFrame, assets: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for every candidate and every observation of its file, or one without an observation: candidate_id, status,
    file_id, file_name, event_id, source_id, source_name, and n_observations of the candidate. A file that is gone or was never
    observed leaves nulls; candidates without a file stay."""
    seen = events.select("event_id", "file_id", "source_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")
    counts = events.groupBy("file_id").agg(F.count("*").alias("n_observations"))
    out = candidates.join(assets.select("file_id", "file_name"), "file_id", "left").join(seen, "file_id", "left").join(counts, "file_id", "left")
    return out.select("candidate_id", "status", "file_id", "file_name", "event_id", "source_id", "source_name", F.coalesce("n_observations", F.lit(0)).alias("n_observations"))
