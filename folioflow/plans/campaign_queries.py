"""Campaigns over the driver's orders and events, with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import campaigns, ingest
from .driver_queries import query


def _merged(spark, d):
    """Two orders of three are known items of their customer's segment; three of four are found again, half of them changed."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    key = [F.col("c_mktsegment").alias("campaign_id"), F.col("o_orderkey").cast("string").alias("source_item_key")]
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "duplicate").when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("downloading")
    then, now = F.to_timestamp(F.lit("2020-01-01")), F.to_timestamp(F.lit("2021-01-01"))
    items = orders.where("o_orderkey % 3 > 0").select(*key, F.lit("old").alias("title"), F.lit("u").alias("detail_url"), F.col("o_orderpriority").alias("fingerprint"), status.alias("status"), then.alias("first_seen_at"), then.alias("last_seen_at"))
    found = orders.where("o_orderkey % 4 > 0").select(*key, F.lit("new").alias("title"), F.lit("u").alias("detail_url"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("fingerprint"))
    return campaigns.merged(items, found.unionByName(found), now)


_SQL = """WITH o AS (SELECT c_mktsegment AS campaign_id, CAST(o_orderkey AS VARCHAR) AS source_item_key, o_orderkey % 3 > 0 AS known, o_orderkey % 4 > 0 AS seen, o_orderpriority AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS b,
  CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'duplicate' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'downloading' END AS s FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT campaign_id, source_item_key, CASE WHEN seen THEN 'new' ELSE 'old' END AS title, CASE WHEN seen THEN b ELSE a END AS fingerprint,
  CASE WHEN NOT known THEN 'discovered' WHEN seen AND s IN ('done', 'duplicate') AND a IS DISTINCT FROM b THEN 'changed' ELSE s END AS status, CASE WHEN known THEN 2020 ELSE 2021 END AS first_seen, CASE WHEN seen THEN 2021 ELSE 2020 END AS last_seen FROM o WHERE known OR seen)
"""


@query(_SQL + "SELECT * FROM m")
def campaign_merge(spark, d):
    return _merged(spark, d).select("campaign_id", "source_item_key", "title", "fingerprint", "status", F.year("first_seen_at").cast("long").alias("first_seen"), F.year("last_seen_at").cast("long").alias("last_seen"))


@query(_SQL + """SELECT campaign_id, count(*) AS discovered, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN count(*) FILTER (status IN ('discovered', 'downloading')) > 0 THEN 'running' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM m GROUP BY 1""")
def campaign_progress(spark, d):
    return ingest.campaign_status(_merged(spark, d)).drop("active")


@query("""WITH e AS (SELECT user_id, ts, event_type, event_id, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS state FROM e),
g AS (SELECT user_id, state, min(event_type) AS event_type, min(ts) AS valid_from, max(ts) AS last_seen, count(*) AS sightings FROM s GROUP BY ALL)
SELECT user_id, event_type, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY state) AS valid_to, last_seen, sightings FROM g""")
def item_intervals(spark, d):
    """Types of a user's events as the states that the user goes through."""
    return campaigns.intervals(table(spark, d, "events"), ["user_id"], "ts", "event_type")
