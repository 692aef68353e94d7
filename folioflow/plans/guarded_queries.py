"""A guarded clean-up over the driver's orders, with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import guarded
from .driver_queries import query


def _state(spark, d) -> tuple[guarded.Tables, guarded.Plan]:
    """Orders as archives, their lines' parts as mounted files, parts as assets; a customer's first order is the one that
    stays, its others with status P are withdrawn. Parts divisible by five are lost, and the next part stands for one."""
    tenant = lambda c: F.concat(F.lit("t"), (F.col(c) % 2).cast("string"))
    stamp = F.to_timestamp(F.lit("2020-01-01"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("archive_id"), tenant("o_custkey").alias("tenant"), F.when(F.col("o_orderkey") % 9 > 0, "cost_info").otherwise("quota").alias("domain"), F.lit(True).alias("is_current"), (F.col("o_orderkey") % 10 == 0).alias("is_withdrawn"), stamp.alias("updated_at"), F.col("o_custkey").alias("customer"), "o_orderstatus")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), tenant("p_partkey").alias("tenant")).where("file_id % 5 > 0")
    mounts = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mount_id"), F.col("l_orderkey").alias("archive_id")).agg(F.min("l_partkey").alias("file_id")).withColumn("linked_by", F.when(F.col("mount_id") % 3 > 0, "import"))
    first = orders.groupBy("customer").agg(F.min("archive_id").alias("canonical_id"))
    withdraw = orders.where("o_orderstatus = 'P'").join(first, "customer").where("archive_id <> canonical_id").select("archive_id", "canonical_id")
    relink = mounts.where("file_id % 5 = 0").select("mount_id", "archive_id", F.col("file_id").alias("missing_file_id"), F.when(F.col("mount_id") % 7 > 0, F.array(F.col("file_id") + 1)).otherwise(F.array(F.col("file_id") + 1, F.col("file_id") + 2)).alias("candidates"))
    return guarded.Tables(orders.drop("customer", "o_orderstatus"), mounts, parts), guarded.Plan(withdraw, relink)


_SQL = """
WITH a AS (SELECT o_orderkey AS id, o_custkey, 't' || o_custkey % 2 AS tenant, o_orderkey % 9 > 0 AND o_orderkey % 10 > 0 AS active, o_orderkey % 10 = 0 AS withdrawn, o_orderstatus, min(o_orderkey) OVER (PARTITION BY o_custkey) AS canonical FROM orders),
f AS (SELECT p_partkey AS id, 't' || p_partkey % 2 AS tenant FROM part WHERE p_partkey % 5 > 0),
m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS archive, min(l_partkey) AS file FROM lineitem GROUP BY ALL),
w AS (SELECT a.*, c.active AS c_active, c.withdrawn AS c_withdrawn FROM a JOIN a c ON c.id = a.canonical WHERE a.o_orderstatus = 'P' AND a.id <> a.canonical),
r AS (SELECT m.*, a.active, a.tenant, f.id AS known, f.tenant AS f_tenant, m.id % 7 > 0 AS single FROM m LEFT JOIN a ON a.id = m.archive LEFT JOIN f ON f.id = m.file + 1 WHERE m.file % 5 = 0)
"""


@query(_SQL + """
SELECT 'ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO' AS reason, CAST(id AS VARCHAR) AS target_id FROM w WHERE NOT active
UNION ALL SELECT 'CANONICAL_ARCHIVE_NOT_ACTIVE', CAST(canonical AS VARCHAR) FROM w WHERE NOT c_active
UNION ALL SELECT 'ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO', CAST(archive AS VARCHAR) FROM r WHERE active IS NOT TRUE
UNION ALL SELECT 'RELINK_CANDIDATE_NOT_UNIQUE', CAST(archive AS VARCHAR) FROM r WHERE NOT single
UNION ALL SELECT 'RECOVERY_FILE_ASSET_DISAPPEARED', CAST(id AS VARCHAR) FROM r WHERE known IS NULL
UNION ALL SELECT 'RECOVERY_FILE_ASSET_TENANT_MISMATCH', CAST(id AS VARCHAR) FROM r WHERE (f_tenant = tenant) IS NOT TRUE""")  # fmt: skip
def guarded_violations(spark, d):
    return guarded.violations(*_state(spark, d))


@query(_SQL + """
, e AS (
  SELECT CAST(id AS VARCHAR) AS archive_id, 'ARCHIVE_WITHDRAWN' AS action, CAST(id AS VARCHAR) AS target_id, '{"is_current":true,"is_withdrawn":false}' AS before,
    '{"is_current":false,"is_withdrawn":true,"canonical_archive_id":"' || canonical || '","approved_report_sha256":"approved"}' AS after FROM w WHERE active AND c_active
  UNION ALL
  SELECT CAST(archive AS VARCHAR), 'ARCHIVE_FILE_RELINKED', CAST(id AS VARCHAR), '{"archive_file_id":"' || id || '","file_id":"' || file || '","linked_by":' || CASE WHEN id % 3 > 0 THEN '"import"' ELSE 'null' END || '}',
    '{"archive_file_id":"' || id || '","file_id":"' || (file + 1) || '","linked_by":"clean-up","approved_report_sha256":"approved"}' FROM r WHERE active AND single AND f_tenant = tenant)
SELECT sha256('approved|' || action || '|' || target_id) AS event_id, archive_id, action, target_id, before, after FROM e""")
def guarded_events(spark, d):
    """Events of that part of the plan that the tables allow."""
    now, plan = _state(spark, d)
    wrong = guarded.violations(now, plan)
    bad = lambda *reasons: wrong.where(F.col("reason").isin(*reasons)).select("target_id").distinct()
    text = lambda c: F.col(c).cast("string")
    withdraw = plan.withdraw.join(bad("ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO"), text("archive_id") == F.col("target_id"), "left_anti").join(bad("CANONICAL_ARCHIVE_NOT_ACTIVE"), text("canonical_id") == F.col("target_id"), "left_anti")
    relink = plan.relink.where("size(candidates) = 1").join(bad("ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO"), text("archive_id") == F.col("target_id"), "left_anti")
    relink = relink.join(bad("RECOVERY_FILE_ASSET_DISAPPEARED", "RECOVERY_FILE_ASSET_TENANT_MISMATCH"), text("mount_id") == F.col("target_id"), "left_anti")
    made = guarded.outcome(now, guarded.Plan(withdraw, relink), "approved", "clean-up", F.current_timestamp())
    return made["audit"].join(made["events"].select("event_id", "archive_id"), "event_id").select("event_id", "archive_id", "action", "target_id", "before", "after")
