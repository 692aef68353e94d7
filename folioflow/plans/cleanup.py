"""Clean-up of duplicate archives and lost files, reconciliation, and counts before a deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(members: DataFrame, archives: DataFrame, orphans: DataFrame) -> DataFrame:
    """(archive_id, action, canonical_id) of what a clean-up would do.

    members: node, component of archives that share evidence; archives: archive_id, has_mount, is_rebuilt,
    status_score, created_at; orphans: archive_id, candidates (how many files could stand for one lost reference).
    A group's canonical archive has a mount, wasn't rebuilt, has the best status and is the oldest; the others are
    withdrawn if it has a mount or all its lost files can be found. Whatever else has lost files drops the reference,
    links the one candidate, or waits for someone. Groups are aggregates; no group is gathered.
    """
    lost = orphans.groupBy("archive_id").agg(F.bool_and(F.col("candidates") == 1).alias("found"))
    known = archives.join(lost, "archive_id", "left")
    rank = F.struct("has_mount", (~F.col("is_rebuilt")).alias("own"), "status_score", (-F.unix_micros("created_at")).alias("age"), F.col("archive_id").alias("id"))
    own = members.select(F.col("node").alias("archive_id"), "component").join(known, "archive_id")
    ready = F.max_by(F.col("has_mount") | F.coalesce("found", F.lit(False)), rank)
    groups = own.groupBy("component").agg(F.count("*").alias("size"), F.max_by("archive_id", rank).alias("canonical_id"), ready.alias("ready")).where("size > 1")
    placed = known.join(own.select("archive_id", "component").join(groups, "component").select("archive_id", "canonical_id", "ready"), "archive_id", "left")
    gone = F.col("ready") & (F.col("archive_id") != F.col("canonical_id"))
    action = F.when(gone, "withdraw_duplicate").when(F.col("found").isNull(), None).when(F.col("has_mount"), "remove_redundant_orphan_reference").when(F.col("found"), "relink_orphan").otherwise("manual_review")
    out = placed.select("archive_id", action.alias("action"), F.when(gone, F.col("canonical_id")).alias("canonical_id"))
    return out.where("action IS NOT NULL")


def reconciliation(inventory: DataFrame, candidates: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: raw_total files (file_id), how many have a candidate of each status, and whether these add up."""
    own = inventory.select("file_id").distinct()
    counts = own.join(candidates.select("file_id", "status"), "file_id", "left")
    state = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return counts.agg(F.count_distinct("file_id").alias("raw_total"), *state, F.count("status").alias("__all")).withColumn("invariant_ok", F.col("raw_total") == F.col("__all")).drop("__all")


def impact(gone: DataFrame, key: str, dependents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, n): the rows of each dependent (rows, its key) that go if the given ones are deleted."""
    ids, out = gone.select(F.col(key).alias("__id")).distinct(), None
    for name, (rows, own) in sorted(dependents.items()):
        n = rows.join(ids, F.col(own) == F.col("__id"), "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def integrity(assets: DataFrame, blobs: DataFrame) -> DataFrame:
    """(problem, n) for assets (file_id, blob_hash, size) against blobs (blob_hash, size): no hash, a hash that no blob
    has, a hash that several blobs claim, a size that differs; one row for each, with 0 where all is well."""
    named, own = assets.where("coalesce(blob_hash, '') <> ''"), blobs.select("blob_hash", F.col("size").alias("blob_size"))
    checks = {
        "no_hash": assets.where("coalesce(blob_hash, '') = ''"),
        "unknown_hash": named.join(own, "blob_hash", "left_anti"),
        "repeated_blob": blobs.groupBy("blob_hash").count().where("count > 1"),
        "other_size": named.join(own, "blob_hash").where("NOT size <=> blob_size"),
    }
    out = None
    for name, rows in checks.items():
        n = rows.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out
