"""The queue's states in a stream, over several batches and a restart."""

import datetime as dt

from pyspark.sql import functions as F

from folioflow.streaming.tasks import source_states, task_states

START = dt.datetime(2024, 1, 1)
EVENTS = "task_id string, source_id string, kind string, at timestamp, worker string"
OUTCOMES = "source_id string, at timestamp, status string, found int, last_key string, last_date date"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, folder, batches, schema, made):
    """What a stream gives for batches that come one after another, stopped and started again at each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = made(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        keep = lambda b, _: b.write.mode("append").parquet(f"{folder}/out")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_leases_retries_and_dead_letters(spark, tmp_path):
    batches = [
        [("a", "s", "planned", at(0), None), ("b", "s", "planned", at(0), None), ("a", "s", "leased", at(10), "w1"), ("a", "s", "leased", at(11), "w2"), ("a", "s", "failed", at(12), "w2"), (None, "s", "planned", at(0), None), ("x", "s", "planned", None, None)],
        [("a", "s", "failed", at(20), "w1"), ("a", "s", "leased", at(60), "w1"), ("a", "s", "leased", at(140), "w1"), ("b", "s", "leased", at(150), "w2"), ("b", "s", "heartbeat", at(200), "w2"), ("a", "s", "failed", at(190), "w1"), ("b", "s", "heartbeat", at(205), "w9")],
        [("c", "t", "planned", at(230), None)],
        [("c", "t", "leased", at(400), "w3"), ("b", "s", "done", at(401), "w2")],
        [("c", "t", "done", at(420), "w3"), ("b", "s", "leased", at(430), "w4"), ("b", "s", "done", at(440), "w4"), ("c", "t", "failed", at(450), "w3")],
    ]
    found = run(spark, str(tmp_path), batches, EVENTS, lambda s: task_states(s, lease_seconds=60, attempts=2))
    seconds = lambda c: (F.unix_timestamp(c) - F.unix_timestamp(F.lit(START))).cast("int")
    got = sorted((r.task_id, r.at, r.status, r.attempt, r.run_at, r.worker) for r in found.select("task_id", seconds("at").alias("at"), "status", "attempt", seconds("run_at").alias("run_at"), "worker").collect())
    # a is leased by one worker only, fails, waits 120 s, is leased again and dies; b's lease ends 60 s after its last
    # heartbeat, so the work is lost and done again
    assert [g[:4] for g in got if g[0] == "a"] == [("a", 0, "pending", 0), ("a", 10, "running", 0), ("a", 20, "pending", 1), ("a", 140, "running", 1), ("a", 190, "dead_letter", 2)]
    assert [g[4] for g in got if g[:4] == ("a", 20, "pending", 1)] == [140]
    assert [g[1:] for g in got if g[0] == "b"] == [(0, "pending", 0, 0, None), (150, "running", 0, 0, "w2"), (260, "pending", 0, 260, None), (430, "running", 0, 260, "w4"), (440, "succeeded", 0, 260, None)]
    assert [g[1:3] for g in got if g[0] == "c"] == [(230, "pending"), (400, "running"), (420, "succeeded")]
    assert {g[0] for g in got} == {"a", "b", "c"}


def test_quarantine_and_cursor(spark, tmp_path):
    day = dt.date
    batches = [
        [("s", at(1), "succeeded", 2, "k1", day(2024, 1, 5)), ("s", at(2), "succeeded", 0, None, None), ("t", at(1), "dead_letter", None, None, None), ("s", at(3), "pending", None, None, None), (None, at(3), "succeeded", 1, "x", None)],
        [("t", at(k), "dead_letter", None, None, None) for k in (2, 3)] + [("s", at(4), "succeeded", 1, "k2", day(2024, 1, 2))],
        [("t", at(9), "resumed", None, None, None), ("t", at(10), "succeeded", 1, "k9", None), ("s", at(9), "dead_letter", None, None, None)],
    ]
    got = run(spark, str(tmp_path), batches, OUTCOMES, lambda s: source_states(s, streak=3)).orderBy("source_id", "at").collect()
    assert [tuple(r)[2:] for r in got if r.source_id == "s"] == [
        ("active", 0, "k1", day(2024, 1, 5), 0), ("active", 0, "k1", day(2024, 1, 5), 1), ("active", 0, "k1", day(2024, 1, 5), 1), ("active", 0, "k2", day(2024, 1, 5), 0), ("active", 1, "k2", day(2024, 1, 5), 0),
    ]
    assert [(r.status, r.streak, r.last_key) for r in got if r.source_id == "t"] == [("active", 1, None), ("active", 2, None), ("manual_recovery", 3, None), ("active", 0, None), ("active", 0, "k9")]
