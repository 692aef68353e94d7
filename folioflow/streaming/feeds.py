"""Streams over appended event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with a watermark; times without a zone are the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def outbox(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """One message for each event, by its key archive_event:<id>; repeats within the delay are dropped."""
    keyed = events.select(F.concat(F.lit("archive_event:"), F.col("event_id").cast("string")).alias("idempotency_key"), time, F.to_json(F.struct("*")).alias("payload"))
    return _timed(keyed, time, delay).dropDuplicatesWithinWatermark(["idempotency_key"]) if events.isStreaming else keyed.dropDuplicates(["idempotency_key"])


def poll(stream: DataFrame, apply, checkpoint: str):
    """Run over all that is there, then stop; apply(batch, number) must be idempotent, as a batch can come again."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_new(target: str, key: str):
    """A function for poll that appends the rows whose key the target hasn't got."""

    def apply(batch: DataFrame, _number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(target).select(key)
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(known, key, "left_anti")
        new.write.mode("append").parquet(target)

    return apply


def tumbling(events: DataFrame, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and values by window and type (an extension: the catalogue itself has no event-time windows)."""
    events = _timed(events, time, late) if events.isStreaming else events
    out = events.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a user, which end after a gap (an extension likewise)."""
    events = _timed(events, time, late) if events.isStreaming else events
    out = events.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
