"""Duplicate components over shared evidence."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> str:
    """The folder for checkpoints: the cluster's, or a temporary one in local mode."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="folioflow-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the cluster's folder, or in a temporary one in local mode."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet beside the checkpoints and read back: for wide rows, as columns take a fraction of a checkpoint."""
    path = f"{_shared(df)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(rows: DataFrame, node: str, evidence: str) -> DataFrame:
    """(node, component) for rows (node, evidence): nodes that share evidence, directly or over others, get the
    smallest of their nodes. Labels of nodes that share any go to the evidence and back, and jump to their own label's
    label, until none changes: each round is two aggregates, and no group is gathered."""
    rows = rows.select(F.col(node).alias("n"), F.col(evidence).alias("e")).where("n IS NOT NULL AND e IS NOT NULL")
    # Evidence of one node links nothing: only what several share goes through the rounds.
    shared = rows.groupBy("e").agg(F.min("n").alias("first"), F.max("n").alias("last")).where("first < last").select("e")
    links = settled(rows.join(shared, "e", "left_semi").distinct())
    nodes = rows.select("n").distinct()
    labels = settled(links.select("n").distinct().withColumn("c", F.col("n")))
    while True:
        least = links.join(labels, "n").groupBy("e").agg(F.min("c").alias("c"))
        moved = links.join(least, "e").groupBy("n").agg(F.min("c").alias("m"))
        stepped = labels.join(moved, "n").select("n", "c", F.least("c", "m").alias("m"))
        jump = stepped.select(F.col("n").alias("m"), F.col("m").alias("j"))
        new = settled(stepped.join(jump, "m", "left").select("n", "c", F.least("m", F.coalesce("j", "m")).alias("m")))
        if new.where("m < c").isEmpty():
            return nodes.join(new.select("n", "m"), "n", "left").select(F.col("n").alias("node"), F.coalesce("m", "n").alias("component"))
        labels = new.select("n", F.col("m").alias("c"))


def numbered(rows: DataFrame, *order: Column, out: str = "number") -> DataFrame:
    """rows with their place in the order, from 1. Rows are dealt out by ranges, numbered in each, and offset by the sizes of
    the ranges before; only those sizes meet in one task."""
    ranged = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + local + 1).drop("__at", "__part", "__before")


def duplicate_groups(found: DataFrame, archives: DataFrame) -> DataFrame:
    """Groups of two or more archives (archive_id, is_valid, is_rebuilt, status_score, created_at), numbered from the
    largest: the canonical one has a valid mount, wasn't rebuilt, has the best status and is the oldest."""
    joined = found.select(F.col("node").alias("archive_id"), "component").join(archives, "archive_id")
    rank = F.struct(F.col("is_valid"), ~F.col("is_rebuilt"), F.col("status_score"), -F.unix_timestamp("created_at"), F.col("archive_id"))
    groups = joined.groupBy("component").agg(F.count("*").alias("size"), F.max_by("archive_id", rank).alias("canonical"), F.array_sort(F.collect_set("archive_id")).alias("members")).where("size > 1")
    return numbered(groups, F.desc("size"), F.asc("component")).withColumn("group_id", F.format_string("DUP-%04d", "number")).drop("number")


def shared_by_all(rows: DataFrame, group: str, member: str, evidence: str) -> DataFrame:
    """(group, evidence) that every member of the group has; groups merged over several links may share none.
    Members are counted, not gathered."""
    own = rows.select(group, member, evidence).distinct()
    sizes = own.groupBy(group).agg(F.count_distinct(member).alias("__size"))
    held = own.where(F.col(evidence).isNotNull()).groupBy(group, evidence).agg(F.count("*").alias("__held"))
    return held.join(sizes, group).where("__held = __size").select(group, evidence)
