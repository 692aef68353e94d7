"""The blob audit over the driver's lines and parts, with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import blob_audit
from .driver_queries import query


def _frames(spark, d):
    """Lines as files, parts as blobs and objects, lines again as observations by suppliers."""
    text = lambda c: F.col(c).cast("string")
    lines = table(spark, d, "lineitem").withColumn("file_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    md5 = F.md5(text("l_partkey"))
    assets = lines.select(
        "file_id", F.concat(F.lit("f"), text("l_suppkey")).alias("file_name"), F.when(F.col("l_orderkey") % 17 == 0, None).when(F.col("l_orderkey") % 19 == 0, "").otherwise(text("l_partkey")).alias("blob_hash"),
        F.when(F.col("l_orderkey") % 11 == 0, "").when(F.col("l_orderkey") % 13 == 0, md5).otherwise(F.concat(md5, md5)).alias("sha256"), F.col("l_quantity").cast("long").alias("file_size"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 2).cast("string")).alias("bucket"), F.when(F.col("l_orderkey") % 23 > 0, F.concat(F.lit("k"), text("l_partkey"))).alias("object_key"),
    )
    part = table(spark, d, "part").select("p_partkey", text("p_partkey").alias("blob_hash"), F.col("p_size").cast("long").alias("byte_size"), F.lit("b0").alias("bucket"), F.concat(F.lit("k"), text("p_partkey")).alias("object_key"))
    events = lines.select("file_id", F.col("l_suppkey").alias("source_id"), F.concat_ws("-", "file_id", "l_partkey", "l_suppkey").alias("event_id"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "quota").otherwise("cost_info").alias("data_domain"))
    return assets, part.where("p_partkey % 4 > 0"), part.where("p_partkey % 3 > 0"), events, sources


_SQL = """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, 'f' || l_suppkey AS file_name, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS blob_hash,
  CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN md5(CAST(l_partkey AS VARCHAR)) ELSE md5(CAST(l_partkey AS VARCHAR)) || md5(CAST(l_partkey AS VARCHAR)) END AS sha256, CAST(l_quantity AS BIGINT) AS size,
  'b' || l_suppkey % 2 AS bucket, CASE WHEN l_orderkey % 23 > 0 THEN 'k' || l_partkey END AS object_key, l_suppkey, l_partkey FROM lineitem),
c AS (SELECT a.*, CASE WHEN coalesce(blob_hash, '') = '' THEN 'none' WHEN b.p_partkey IS NULL THEN 'orphan' WHEN coalesce(b.p_size <> size, FALSE) OR bucket <> 'b0' OR coalesce(object_key <> 'k' || b.p_partkey, FALSE) THEN 'conflict' ELSE 'ok' END AS blob_state,
  CASE WHEN object_key IS NULL THEN 'none' WHEN o.p_partkey IS NULL THEN 'missing' WHEN o.p_size <> size THEN 'size_mismatch' ELSE 'ok' END AS object_state
  FROM a LEFT JOIN part b ON CAST(b.p_partkey AS VARCHAR) = blob_hash AND b.p_partkey % 4 > 0 LEFT JOIN part o ON 'k' || o.p_partkey = object_key AND bucket = 'b0' AND o.p_partkey % 3 > 0),
g AS (SELECT count(DISTINCT size) > 1 OR count(DISTINCT bucket) > 1 AS bad FROM a WHERE sha256 <> '' GROUP BY sha256 HAVING count(*) > 1)
"""


@query(_SQL + """SELECT 'file_asset' AS section, 'total' AS measure, count(*) AS n FROM c
UNION ALL SELECT 'blob_hash', 'blob_hash_set', count(*) FILTER (coalesce(blob_hash, '') <> '') FROM c UNION ALL SELECT 'blob_hash', 'blob_hash_null', count(*) FILTER (coalesce(blob_hash, '') = '') FROM c
UNION ALL SELECT 'blob_hash', 'blob_exists', count(*) FILTER (blob_state IN ('ok', 'conflict')) FROM c UNION ALL SELECT 'blob_hash', 'blob_orphan', count(*) FILTER (blob_state = 'orphan') FROM c
UNION ALL SELECT 'sha256', 'sha256_empty', count(*) FILTER (sha256 = '') FROM c UNION ALL SELECT 'sha256', 'sha256_length_64', count(*) FILTER (length(sha256) = 64) FROM c UNION ALL SELECT 'sha256', 'sha256_short', count(*) FILTER (length(sha256) BETWEEN 1 AND 63) FROM c
UNION ALL SELECT 'same_sha256', 'duplicate_sha_groups', count(*) FROM g UNION ALL SELECT 'same_sha256', 'conflict_groups', count(*) FILTER (bad) FROM g UNION ALL SELECT 'blob_metadata', 'blob_conflict', count(*) FILTER (blob_state = 'conflict') FROM c
UNION ALL SELECT 'domain_files', 'files', count(*) FROM a JOIN (SELECT l_orderkey * 10 + l_linenumber AS file_id, l_suppkey AS s FROM lineitem) USING (file_id) JOIN supplier ON s_suppkey = s AND s_nationkey % 2 = 0
UNION ALL SELECT 'foreign_key', 'holds', CAST(count(*) FILTER (blob_state = 'orphan') = 0 AS BIGINT) FROM c
UNION ALL SELECT 'objects', 'with_object_key', count(*) FILTER (object_state <> 'none') FROM c UNION ALL SELECT 'objects', 'exists_ok', count(*) FILTER (object_state = 'ok') FROM c
UNION ALL SELECT 'objects', 'missing', count(*) FILTER (object_state = 'missing') FROM c UNION ALL SELECT 'objects', 'size_mismatch', count(*) FILTER (object_state = 'size_mismatch') FROM c""")
def blob_sections(spark, d):
    assets, blobs, objects, events, sources = _frames(spark, d)
    return blob_audit.sections(assets, blobs, objects, events, sources)


@query(_SQL + """SELECT file_id, file_name, blob_state, object_state, sha256 FROM c""")
def blob_states(spark, d):
    assets, blobs, objects, _, _ = _frames(spark, d)
    return blob_audit.checked(assets, blobs, objects).select("file_id", "file_name", "blob_state", "object_state", "sha256")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, l_suppkey AS source_id, concat_ws('-', l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) AS event_id FROM lineitem WHERE l_partkey % 3 > 0),
k AS (SELECT file_id, count(*) AS n FROM e GROUP BY 1), f AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, min('f' || l_suppkey) AS file_name FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1),
c AS (SELECT o_orderkey AS candidate_id, o_orderstatus AS status, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey * 10 + 1 END AS file_id FROM orders)
SELECT candidate_id, status, file_id, file_name, event_id, source_id, s_name AS source_name, coalesce(n, 0) AS n_observations FROM c LEFT JOIN f USING (file_id) LEFT JOIN e USING (file_id) LEFT JOIN k USING (file_id) LEFT JOIN supplier ON s_suppkey = source_id AND s_suppkey % 2 = 0""")
def candidate_observations(spark, d):
    assets, _, _, _, sources = _frames(spark, d)
    lines = table(spark, d, "lineitem").withColumn("file_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    events = lines.where("l_partkey % 3 > 0").select("file_id", F.col("l_suppkey").alias("source_id"), F.concat_ws("-", "file_id", "l_partkey", "l_suppkey").alias("event_id"))
    known = lines.where("l_suppkey % 7 > 0").groupBy("file_id").agg(F.min(F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))).alias("file_name"))
    candidates = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderkey") * 10 + 1).alias("file_id"))
    return blob_audit.observations(candidates, known, events, sources.where("source_id % 2 = 0"))
