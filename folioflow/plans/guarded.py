"""Guarded changes: an approved plan is applied to the state it was made for, or not at all.

The tables of a ledger are Parquet folders, one for each commit, and a log with a file for each version that names them. A
change is written beside what is there and becomes visible by the creation of one log file, which fails if another change
took that version first; rows of events, audit and outbox come in the same commit as what they tell of.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """The plan may not be applied; nothing was changed."""


class Conflict(Refused):
    """Another change was committed first."""


def digest(rows: DataFrame) -> str:
    """A digest of the rows as a bag: neither their order nor that of their columns matters, repeats do. One aggregate."""
    names = sorted(rows.columns)
    own = F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in names]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    row = rows.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count("*"), *[F.sum(f"p{k}") for k in range(4)]).first()
    import hashlib

    return hashlib.sha256(json.dumps([names, *[str(v) for v in row]]).encode()).hexdigest()


@dataclass(frozen=True)
class Tables:
    """archives: archive_id, tenant, domain, is_current, is_withdrawn, updated_at. mounts: mount_id, archive_id, file_id,
    linked_by. assets: file_id, tenant."""

    archives: DataFrame
    mounts: DataFrame
    assets: DataFrame


@dataclass(frozen=True)
class Plan:
    """withdraw: archive_id, canonical_id. relink: mount_id, archive_id, missing_file_id, candidates (array of file ids)."""

    withdraw: DataFrame
    relink: DataFrame

    def digest(self) -> str:
        return digest(self.withdraw.select("archive_id", "canonical_id")) + digest(self.relink.select("mount_id", "archive_id", "missing_file_id", F.array_sort("candidates").alias("candidates")))


def violations(now: Tables, plan: Plan, domain: str = "cost_info") -> DataFrame:
    """(reason, target_id) of everything in the plan that the tables don't allow; the reasons are as published. A null in a
    table never satisfies a condition."""
    archives = now.archives.select("archive_id", "tenant", (~F.col("is_withdrawn") & (F.col("domain") == domain)).alias("active"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    mine = plan.withdraw.join(archives, "archive_id", "left")
    theirs = archives.select(F.col("archive_id").alias("canonical_id"), F.col("tenant").alias("canonical_tenant"), F.col("active").alias("canonical_active"), F.lit(True).alias("there"))
    mine = mine.join(theirs, "canonical_id", "left")
    links = plan.relink.join(archives, "archive_id", "left").join(now.mounts.select("mount_id", F.col("archive_id").alias("on"), "file_id"), "mount_id", "left").withColumn("candidate", F.get("candidates", F.lit(0)))
    links = links.join(now.assets.select(F.col("file_id").alias("candidate"), F.col("tenant").alias("asset_tenant"), F.lit(True).alias("known")), "candidate", "left")
    out = lambda rows, test, reason, target: rows.where(test).select(F.lit(reason).alias("reason"), F.col(target).cast("string").alias("target_id"))
    found = [
        out(mine, F.col("tenant").isNull() | F.col("there").isNull(), "ACTION_OR_CANONICAL_ARCHIVE_DISAPPEARED", "archive_id"),
        out(mine, ~is_(F.col("active")), "ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO", "archive_id"),
        out(mine, ~is_(F.col("canonical_active")), "CANONICAL_ARCHIVE_NOT_ACTIVE", "canonical_id"),
        out(mine, ~is_(F.col("tenant") == F.col("canonical_tenant")), "CANONICAL_ARCHIVE_TENANT_MISMATCH", "archive_id"),
        out(links, ~is_(F.col("active")), "ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO", "archive_id"),
        out(links, F.col("on").isNull(), "ORPHAN_REFERENCE_DISAPPEARED", "mount_id"),
        out(links, ~is_(F.size("candidates") == 1), "RELINK_CANDIDATE_NOT_UNIQUE", "archive_id"),
        out(links, F.col("known").isNull(), "RECOVERY_FILE_ASSET_DISAPPEARED", "mount_id"),
        out(links, ~is_((F.col("on") == F.col("archive_id")) & (F.col("file_id") == F.col("missing_file_id"))), "ORPHAN_REFERENCE_CHANGED", "mount_id"),
        out(links, ~is_(F.col("asset_tenant") == F.col("tenant")), "RECOVERY_FILE_ASSET_TENANT_MISMATCH", "mount_id"),
        out(plan.withdraw.groupBy("archive_id").count(), F.col("count") > 1, "ACTION_REPEATED", "archive_id"),
        out(plan.relink.groupBy("mount_id").count(), F.col("count") > 1, "ACTION_REPEATED", "mount_id"),
    ]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})


def outcome(now: Tables, plan: Plan, approved: str, actor: str, at: Column) -> dict[str, DataFrame]:
    """archives and mounts as they are afterwards, and the new rows of events, audit and outbox, for a plan without
    violations. Ids of events come from the approval, so a plan that is applied again makes the same rows."""
    gone = plan.withdraw.select("archive_id", "canonical_id")
    links = plan.relink.select("mount_id", "archive_id", F.get("candidates", F.lit(0)).alias("to_file"))
    touched = gone.select("archive_id", F.lit(True).alias("gone")).unionByName(links.select("archive_id", F.lit(False).alias("gone"))).groupBy("archive_id").agg(F.bool_or("gone").alias("gone"))
    kept = now.archives.join(touched, "archive_id", "left")
    gone_now = F.coalesce("gone", F.lit(False))
    changes = {"is_current": F.when(gone_now, False).otherwise(F.col("is_current")), "is_withdrawn": F.when(gone_now, True).otherwise(F.col("is_withdrawn")), "updated_at": F.when(F.col("gone").isNotNull(), at).otherwise(F.col("updated_at"))}
    archives = kept.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in now.archives.columns])
    linked = now.mounts.join(links.select("mount_id", "to_file"), "mount_id", "left")
    changes = {"file_id": F.coalesce("to_file", "file_id"), "linked_by": F.when(F.col("to_file").isNotNull(), actor).otherwise(F.col("linked_by"))}
    mounts = linked.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in now.mounts.columns])

    text = lambda c: F.col(c).cast("string")
    withdrawn = gone.join(now.archives.select("archive_id", "is_current", "is_withdrawn"), "archive_id").select(
        text("archive_id").alias("archive_id"), F.lit("ARCHIVE_WITHDRAWN").alias("event_type"), F.lit("ARCHIVE_WITHDRAWN").alias("action"), F.lit("archive").alias("target_type"), text("archive_id").alias("target_id"),
        _json(is_current=F.col("is_current"), is_withdrawn=F.col("is_withdrawn")).alias("before"),
        _json(is_current=F.lit(False), is_withdrawn=F.lit(True), canonical_archive_id=text("canonical_id"), approved_report_sha256=F.lit(approved)).alias("after"),
    )
    attached = links.join(now.mounts.select("mount_id", "file_id", "linked_by"), "mount_id").select(
        text("archive_id").alias("archive_id"), F.lit("ARCHIVE_FILE_ATTACHED").alias("event_type"), F.lit("ARCHIVE_FILE_RELINKED").alias("action"), F.lit("archive_file").alias("target_type"), text("mount_id").alias("target_id"),
        _json(archive_file_id=text("mount_id"), file_id=text("file_id"), linked_by=F.col("linked_by")).alias("before"),
        _json(archive_file_id=text("mount_id"), file_id=text("to_file"), linked_by=F.lit(actor), approved_report_sha256=F.lit(approved)).alias("after"),
    )
    told = withdrawn.unionByName(attached).withColumn("event_id", F.sha2(F.concat_ws("|", F.lit(approved), "action", "target_id"), 256)).withColumn("actor_id", F.lit(actor)).withColumn("occurred_at", at)
    return {
        "archives": archives,
        "mounts": mounts,
        "events": told.select("event_id", "archive_id", "event_type", "actor_id", "before", "after", "occurred_at"),
        "audit": told.select("event_id", "action", "target_type", "target_id", "actor_id", "before", "after", "occurred_at"),
        "outbox": told.select("event_id", F.concat(F.lit("archive_event:"), "event_id").alias("idempotency_key"), F.lit("pending").alias("status")),
    }


#: Tables to which a commit adds; the others are replaced.
GROWING = ("events", "audit", "outbox")


class Ledger:
    """Tables under a folder that the cluster shares, with a log of their versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(log) if f.getPath().getName().endswith(".json")), default=0)

    def _entry(self, version: int) -> dict[str, list[str]]:
        if version == 0:
            return {}
        row = self.spark.read.text(f"{self.root}/_log/{version:020d}.json", wholetext=True).first()
        return json.loads(row[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is named."""
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in self._entry(self.version() if version is None else version)[name]])

    def commit(self, base: int, frames: dict[str, DataFrame]) -> int:
        """Write the frames and make them version base + 1, or raise Conflict if that is taken; what was written then stays
        unseen. Whether two commits can take one version depends on the store creating a file only once."""
        entry = self._entry(base)
        for name, frame in frames.items():
            path = f"{name}/{base + 1:020d}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.root}/{path}")
            entry[name] = [*entry.get(name, []), path] if name in GROWING else [path]
        at = self._path(f"{self.root}/_log/{base + 1:020d}.json")
        if self._fs.exists(at):
            raise Conflict(f"version {base + 1} was committed by someone else")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"version {base + 1} was committed by someone else") from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return base + 1

    def tables(self, version: int | None = None) -> Tables:
        return Tables(*[self.read(n, version) for n in ("archives", "mounts", "assets")])


def apply(ledger: Ledger, planned: Callable[[Tables], Plan], approved: str, actor: str = "catalog_cleanup_apply", at: Column | None = None) -> int:
    """Apply what `planned` makes of the newest tables, if it is what was approved (by its digest) and the tables allow all of
    it; the new version. A plan that drifted, a violated condition or a commit in between raises, and changes nothing."""
    version = ledger.version()
    now = ledger.tables(version)
    plan = planned(now)
    if plan.digest() != approved:
        raise Refused("DATABASE_PLAN_DRIFTED_FROM_APPROVED_REPORT")
    wrong = violations(now, plan).orderBy("reason", "target_id").limit(20).collect()
    if wrong:
        raise Refused("; ".join(f"{r.reason}: {r.target_id}" for r in wrong))
    return ledger.commit(version, outcome(now, plan, approved, actor, F.current_timestamp() if at is None else at))
