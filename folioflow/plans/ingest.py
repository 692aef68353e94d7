"""Incremental ingestion: what is due, leased, new, retried, or already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import backoff_seconds, due
from ..operators.catalog import first_per
from ..operators.sequences import leading_run, until_streak


def due_sources(sources: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """sources (source_id, policy) with their last run and whether they are due; a source with an open task isn't."""
    last = tasks.groupBy("source_id").agg(F.max("scheduled_at").alias("last_at"), F.count_if(F.col("status").isin("pending", "running")).alias("open_tasks"))
    joined = sources.join(last, "source_id", "left")
    return joined.withColumn("is_due", due(F.col("policy"), F.col("last_at"), now) & (F.coalesce("open_tasks", F.lit(0)) == 0))


def leasable(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    """Tasks that wait or whose lease ran out, by priority and age."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_expires_at") <= now))
    return tasks.where(free).orderBy("priority", F.col("scheduled_at").asc_nulls_last(), "created_at", "task_id").limit(limit)


def new_items(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Discovered items whose business key isn't known, each key once."""
    return found.join(known.select(key), key, "left_anti").dropDuplicates([key])


def crawled(found: DataFrame, known: DataFrame, key: str, group: list[str], order: list[Column], stop_after: int = 1) -> DataFrame:
    """What an incremental crawl reads: items up to a run of known ones, with whether each is new. A batch reads
    all items and cuts; it can't stop early."""
    marked = found.join(known.select(key, F.lit(True).alias("known")).distinct(), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return until_streak(marked, group, order, F.col("known"), stop_after).withColumn("is_new", ~F.col("known"))


def retries(tasks: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """Failed tasks with when they may run again, or `dead` once their attempts are used up."""
    failed = tasks.where("status = 'failed'")
    again = F.timestamp_seconds(F.unix_timestamp(now) + backoff_seconds(F.col("attempt")))
    return failed.select("task_id", "source_id", "attempt", F.when(F.col("attempt") >= most, "dead").otherwise("retry").alias("next"), F.when(F.col("attempt") < most, again).alias("run_at"))


def quarantined(tasks: DataFrame, streak: int = 5) -> DataFrame:
    """Sources whose newest tasks failed so often in a row."""
    runs = leading_run(tasks, ["source_id"], [F.desc("created_at"), F.desc("task_id")], F.col("status") == "failed")
    return runs.where(F.col("streak") >= streak)


def stale(tasks: DataFrame, now: Column, minutes: int = 35) -> DataFrame:
    """Running tasks without a sign of life for so long."""
    return tasks.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"interval {minutes} minutes")))


def registered(files: DataFrame, blobs: DataFrame, assets: DataFrame) -> DataFrame:
    """files (tenant, sha256, name, size) with what registering each does: the blob is new or shared, the asset is
    new or the tenant has it. Equal files of a tenant count once, by name."""
    once = first_per(files, ["tenant", "sha256"], [F.col("name").asc_nulls_last()])
    out = once.join(blobs.select("sha256", F.lit(True).alias("b")).distinct(), "sha256", "left").join(assets.select("tenant", "sha256", F.lit(True).alias("a")).distinct(), ["tenant", "sha256"], "left")
    return out.select("tenant", "sha256", "name", "size", F.when(F.col("b"), "shared").otherwise("new").alias("blob"), F.when(F.col("a"), "existing").otherwise("new").alias("asset"))


def seed_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """(key, action) for files (key, sha256) against known ones: ingest, already_ingested, or hash_conflict, which
    is refused."""
    old = known.select("key", F.col("sha256").alias("old"))
    action = F.when(F.col("old").isNull(), "ingest").when(F.col("old") == F.col("sha256"), "already_ingested").otherwise("hash_conflict")
    return files.join(old, "key", "left").select("key", action.alias("action"))


# The states of a book and what may follow each.
NEXT_STATES = {
    "draft": ("ingested", "error"), "ingested": ("parsing", "error"), "parsing": ("parsed", "error"), "parsed": ("qa", "error"),
    "qa": ("qa_passed", "qa_failed", "error"), "qa_passed": ("review", "usable", "archived"), "qa_failed": ("parsed", "review", "error"),
    "review": ("qa", "usable", "parsed", "error"), "usable": ("qa", "archived", "error"), "archived": ("error",), "error": ("draft", "ingested"),
}


def bad_transitions(events: DataFrame) -> DataFrame:
    """Events (book_id, seq, state) that don't follow from the state before."""
    from pyspark.sql import Window

    allowed = events.sparkSession.createDataFrame([(a, b) for a, bs in NEXT_STATES.items() for b in bs], "before string, state string")
    steps = events.withColumn("before", F.lag("state").over(Window.partitionBy("book_id").orderBy("seq")))
    return steps.where("before IS NOT NULL").join(F.broadcast(allowed), ["before", "state"], "left_anti")


def dashboard(sources: DataFrame, tasks: DataFrame) -> DataFrame:
    """sources with their tasks (source_id, task_id, status, error_code, at) counted by status, and the latest one's
    status and error."""
    state = lambda x: F.count_if(F.col("status") == x).alias(f"{x}_count")
    latest = F.max_by(F.struct("status", "error_code"), F.struct("at", "task_id")).alias("latest")
    counts = tasks.groupBy("source_id").agg(*[state(x) for x in ("pending", "running", "done", "failed")], latest)
    out = sources.join(counts, "source_id", "left").na.fill(0, [f"{x}_count" for x in ("pending", "running", "done", "failed")])
    return out.withColumn("last_status", F.col("latest.status")).withColumn("last_error", F.col("latest.error_code")).drop("latest")


def campaign_status(items: DataFrame) -> DataFrame:
    """One row for each campaign of items (campaign_id, status): counts, and its status once nothing is under way."""
    state = lambda *x: F.count_if(F.col("status").isin(*x))
    out = items.groupBy("campaign_id").agg(F.count("*").alias("discovered"), state("done").alias("completed"), state("duplicate").alias("duplicates"), state("failed").alias("failed"), state("discovered", "downloading").alias("active"))
    return out.withColumn("status", F.when(F.col("active") > 0, "running").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))
