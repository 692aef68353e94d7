"""Every operator on the driver's tables, with the same thing in SQL.

The catalogue's own tables aren't there, so orders stand for archives, customers and nations for regions,
events for tasks and conversations for ordered rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import catalog, graph, joins, sequences
from ..session import table
from ..streaming import feeds
from . import cleanup, comparison, coverage, ingest, manifest, notes, quality

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archives of a nation and month."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", _month("o_orderdate").alias("period"))
    return orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


@query("""
WITH src AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS source_id, n_name AS name, (11 + n_regionkey) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00' AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'province' ELSE 'city' END AS scope,
  CASE WHEN n_nationkey % 2 = 0 THEN 'https://s' || n_nationkey WHEN n_nationkey % 5 = 0 THEN 'http://b' || n_nationkey END AS link FROM nation),
t AS (SELECT substr(region, 1, 2) || '0000' AS province, region, name, FALSE AS explicit, NULL AS level, scope = 'city' AS needs, FALSE AS blocked, 'note ' || k AS note, CAST([] AS VARCHAR[]) AS declared, k, 0 AS pos, source_id, scope FROM src WHERE scope = 'city'
  UNION ALL SELECT substr(a.region, 1, 2) || '0000', b.region, 'named ' || b.name, TRUE, CASE WHEN b.k = a.k AND b.region NOT IN ('110000', '120000', '310000', '500000') THEN 'province' ELSE 'city' END, TRUE, b.k % 4 = 3, NULL, CASE WHEN b.k = a.k THEN ['1995-03', '2001-09'] ELSE ['1998-02'] END, a.k, b.k - a.k, a.source_id, a.scope FROM src a JOIN src b ON a.scope = 'province' AND b.k BETWEEN a.k AND a.k + 1),
target AS (SELECT province, region, coalesce(arg_min(name, k * 10 + pos) FILTER (explicit), arg_min(name, k * 10 + pos)) AS name, arg_min(level, k * 10 + pos) FILTER (level IS NOT NULL) AS level, bool_or(needs) AS needs, bool_or(blocked) AS blocked, arg_min(note, k * 10 + pos) FILTER (note IS NOT NULL) AS note,
  coalesce(list(DISTINCT source_id) FILTER (NOT blocked AND scope = 'province'), []) AS p_reg, coalesce(list(DISTINCT source_id) FILTER (NOT blocked AND scope = 'city'), []) AS c_reg FROM t GROUP BY ALL),
said AS (SELECT province, region, source_id, scope, unnest(declared) AS period FROM t),
dec AS (SELECT province, region, period, coalesce(list(DISTINCT source_id) FILTER (scope = 'province'), []) AS p_dec, coalesce(list(DISTINCT source_id) FILTER (scope = 'city'), []) AS c_dec FROM said GROUP BY ALL),
arch AS (SELECT o_orderkey AS id, 'T' || o_custkey % 7 AS title, src.region || CASE WHEN o_orderkey % 11 = 0 THEN '-1' ELSE '' END AS own, strftime(o_orderdate, '%Y-%m') AS period, source_id, CASE WHEN o_orderkey % 5 = 0 THEN 'province' ELSE CASE WHEN c_nationkey % 3 = 1 THEN 'municipality' ELSE scope END END AS scope, CASE WHEN o_custkey % 3 = 0 THEN '第' || o_custkey % 12 || '期' END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN src ON k = c_nationkey WHERE o_orderpriority = '1-URGENT'),
placed AS (SELECT *, unnest(CASE WHEN contains(own, '-') THEN [own, substr(own, 1, 6)] ELSE [own] END) AS region FROM arch),
ev AS (SELECT region, period, min(label) AS label, string_agg(DISTINCT title, ',' ORDER BY title) AS titles, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, coalesce(list(DISTINCT source_id) FILTER (scope = 'province'), []) AS p_ev, coalesce(list(DISTINCT source_id) FILTER (scope = 'city'), []) AS c_ev FROM placed GROUP BY ALL),
f AS (SELECT l_orderkey AS id, l_orderkey * 10 + l_linenumber AS file_id, l_shipmode AS file_name, l_returnflag = 'R' AS is_primary, l_linestatus = 'O' AS main, l_linenumber AS sort_order, l_shipdate AS added_at FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
mounted AS (SELECT region, period, count(*) AS files, min((NOT is_primary, NOT main, sort_order, added_at, file_id, file_name)) AS first FROM placed JOIN f USING (id) GROUP BY ALL),
ob AS (SELECT region, min(period) AS e_min, max(period) AS e_max FROM ev GROUP BY 1), pr AS (SELECT province, region, min(period) AS d_min, max(period) AS d_max FROM said GROUP BY ALL),
m AS (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS period),
c AS (SELECT target.*, m.period, label, titles, ids, files, first, list_sort(list_distinct(list_concat(coalesce(p_ev, []), coalesce(p_dec, []), p_reg))) AS ps, list_sort(list_distinct(list_concat(coalesce(c_ev, []), coalesce(c_dec, []), c_reg))) AS cs,
  n IS NOT NULL OR len(coalesce(p_dec, [])) + len(coalesce(c_dec, [])) > 0 AS covered, coalesce(m.period > greatest(e_max, d_max), FALSE) AS later, coalesce(m.period < least(e_min, d_min), FALSE) AS earlier
  FROM target CROSS JOIN m LEFT JOIN ev USING (region, period) LEFT JOIN mounted USING (region, period) LEFT JOIN dec USING (province, region, period) LEFT JOIN ob USING (region) LEFT JOIN pr USING (province, region)),
v AS (SELECT province, region, period, arg_min(link, pos) AS visit FROM (SELECT province, region, period, unnest(list_concat(cs, ps)) AS source_id, generate_subscripts(list_concat(cs, ps), 1) AS pos FROM c) q JOIN (SELECT source_id, link FROM src) l USING (source_id) WHERE link IS NOT NULL GROUP BY ALL)
SELECT province AS province_code, region AS coverage_region_code, name AS coverage_region_name, level AS target_level, c.period, label AS period_label, coalesce(titles, '') AS evidence_titles, coalesce(ids, '') AS evidence_archive_ids, first[5] AS primary_file_id, first[6] AS primary_file_name, '/api/file-assets/' || first[5] || '/download' AS primary_download_url, coalesce(files, 0) AS file_count,
  CASE WHEN covered THEN 'covered' WHEN blocked OR later OR earlier THEN 'pending_verify' ELSE 'missing' END AS business_coverage_status,
  CASE WHEN len(ps) > 0 AND len(cs) > 0 THEN 'dual_source' WHEN len(cs) > 0 THEN 'city_source_present' WHEN blocked THEN 'source_blocked' WHEN len(ps) > 0 AND needs THEN 'city_source_missing' WHEN len(ps) > 0 THEN 'province_source_only' ELSE 'pending_source_audit' END AS source_completeness_status,
  visit AS source_visit_url, len(ps) AS province_source_count, len(cs) AS city_source_count, array_to_string(list_concat(ps, cs), ',') AS source_ids,
  nullif(concat_ws('；', note, CASE WHEN NOT covered AND later THEN '未发布或发布节奏待核，不按采集失败处理' END, CASE WHEN NOT covered AND earlier THEN '历史期次待回填核验，不按采集失败处理' END), '') AS coverage_note
FROM c LEFT JOIN v USING (province, region, period)""")
def coverage_matrix(spark, d):
    """Nations as sources; the orders of their customers as archives, and order lines as files."""
    return _matrix(spark, d).select(
        *[c for c in "province_code coverage_region_code coverage_region_name target_level period period_label primary_file_id primary_file_name primary_download_url file_count business_coverage_status source_completeness_status source_visit_url province_source_count city_source_count coverage_note".split()],
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("evidence_titles", "evidence_archive_ids", "source_ids")],
    )


def _region(nation, region):
    return F.concat((region + 11).cast("string"), F.lpad(nation.cast("string"), 2, "0"), F.lit("00"))


def _matrix(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), _region(F.col("n_nationkey"), F.col("n_regionkey")).alias("region_code"))
    k, none = F.col("k"), F.lit(None).cast("string")
    after = nation.select((k - 1).alias("k"), F.col("name").alias("name_2"), F.col("region_code").alias("region_2"))
    target = lambda key, code, name, level, months: F.struct(code.alias("region_code"), F.concat(F.lit("named "), name).alias("region_name"), F.lit(level).alias("target_level"), F.lit(True).alias("requires_city_source"), F.when(key % 4 == 3, "source_blocked").alias("source_completeness_status"), none.alias("source_audit_status"), none.alias("source_audit_note"), none.alias("city_source_url"), none.alias("coverage_note"), F.array(*[F.lit(m) for m in months]).alias("declared_periods"))
    two = F.array_compact(F.array(target(k, F.col("region_code"), F.col("name"), "province", ["1995年3月", "2001/09"]), F.when(F.col("region_2").isNotNull(), target(k + 1, F.col("region_2"), F.col("name_2"), "prefecture", ["1998-02", "soon"]))))
    link = lambda test, head: F.when(test, F.concat(F.lit(head), k.cast("string")))
    sources = nation.join(F.broadcast(after), "k", "left").select(
        F.concat(F.lit("N"), k.cast("string")).alias("source_id"), k.alias("seq"), "name", "region_code", none.alias("province"), none.alias("city"), F.when(k % 3 == 0, "province").when(k % 3 == 1, "municipality").otherwise("city").alias("scope"), none.alias("publisher_region_code"), none.alias("coverage_region_code"), F.concat(F.lit("note "), k.cast("string")).alias("remark"),
        F.when(k % 3 == 0, two).alias("targets"), link(k % 2 == 0, "https://s").alias("entry_url"), none.alias("official_url"), none.alias("public_url"), none.alias("url"), link(k % 5 == 0, "http://b").alias("base_url"),
    )
    rows = _archives(spark, d).where("o_orderpriority = '1-URGENT'").join(nation.select(k.alias("c_nationkey"), "region_code"), "c_nationkey")
    archives = rows.select(
        F.col("o_orderkey").alias("archive_id"), F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string")).alias("title"), F.concat("region_code", F.when(F.col("o_orderkey") % 11 == 0, "-1").otherwise("")).alias("region_code"), "period",
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("source_id"), F.when(F.col("o_orderkey") % 5 == 0, "province").alias("publisher_scope"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("第"), (F.col("o_custkey") % 12).cast("string"), F.lit("期"))).alias("issue_label"),
    )
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.concat("l_returnflag", "l_linestatus").alias("file_name"), (F.col("l_returnflag") == "R").alias("is_primary"), F.when(F.col("l_linestatus") == "O", "primary").otherwise("attachment").alias("representation_role"), F.col("l_linenumber").alias("sort_order"), F.col("l_shipdate").alias("added_at"))
    return coverage.matrix(sources, archives, files, "1995-01", "2001-12")


@query("SELECT count(*) AS total, count(*) FILTER (business_coverage_status = 'covered') AS covered, count(*) FILTER (business_coverage_status = 'pending_verify') AS pending_verify, count(*) FILTER (business_coverage_status = 'missing') AS missing FROM (" + ORACLE_SQL["coverage_matrix"] + ")")
def coverage_stats(spark, d):
    return coverage.coverage_stats(_matrix(spark, d))


@query("""SELECT c_nationkey AS region, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY CAST(o_orderkey AS BIGINT)) AS ids
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def issue_groups(spark, d):
    rows = _archives(spark, d).select(F.col("c_nationkey").alias("region"), "period", F.col("o_orderkey").alias("id"))
    return coverage.issue_groups(rows)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return catalog.first_per(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, n_lines FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n_lines,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def primary_pick(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").withColumn("n_lines", F.count("*").over(Window.partitionBy("l_orderkey")))
    order = [F.desc(F.col("l_returnflag") == "R"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return catalog.first_per(rows, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "n_lines")


@query("""SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def list_page(spark, d):
    rows = catalog.matching(table(spark, d, "orders"), {"o_orderstatus": "O"}, o_orderpriority=["1-URGENT", "2-HIGH"])
    top = catalog.page(rows, [F.desc_nulls_last("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")], 50, 100)
    return top.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderdate", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%red%' OR p_brand LIKE '%red%') AND (p_name LIKE '%ring%' OR p_brand LIKE '%ring%')")
def search_all_tokens(spark, d):
    return catalog.search(table(spark, d, "part"), " red  ring ", ["p_name", "p_brand"]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE (p_name ILIKE '%RED%' OR p_type ILIKE '%RED%') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def search_haystack(spark, d):
    return catalog.haystack(catalog.search(table(spark, d, "part"), "RED", ["p_name", "p_type"], True), "BRAND#1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("""SELECT year, o_orderpriority AS edition, n, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS n_outer
FROM (SELECT year(o_orderdate) AS year, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def facet_year_edition(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("edition"))
    return catalog.nested_facet(rows, "year", "edition")


@query("""WITH a AS (SELECT c_mktsegment AS org, r_name AS province, n_name AS city, year(o_orderdate) AS year, strftime(o_orderdate, '%m') AS month FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM (SELECT org, province, city, grouping(org) AS org_all, 2 - grouping(province) - grouping(city) AS level, count(DISTINCT year) AS years, count(DISTINCT month) AS months, count(DISTINCT city) AS cities
FROM a GROUP BY GROUPING SETS ((), (org), (province), (org, province), (province, city), (org, province, city))) WHERE org_all = 1 OR org IS NOT NULL""")
def dimension_index(spark, d):
    small = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_mktsegment").alias("org"), F.col("r_name").alias("province"), F.col("n_name").alias("city"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month"), F.col("n_name").alias("place"))
    measures = [F.count_distinct("year").alias("years"), F.count_distinct("month").alias("months"), F.count_distinct("place").alias("cities")]
    # Every measure counts distinct values, so the grouping sets read each combination once.
    return catalog.dimension_index(rows.distinct(), "org", "province", "city", measures)


@query("SELECT k.event_type, coalesce(n, 0) AS n FROM (SELECT event_type FROM events UNION SELECT * FROM (VALUES ('click'), ('refund'), ('view'))) k LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def status_counts_seeded(spark, d):
    return catalog.seeded_counts(table(spark, d, "events"), "event_type", ["click", "refund", "view"])


@query("""SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flag_list
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1 AND count(DISTINCT l_returnflag) > 1""")
def having_multi_distinct(spark, d):
    # One distinct count and a small set, so that no row is expanded.
    agg = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.array_sort(F.collect_set("l_returnflag")).alias("flag_set"))
    return agg.where("suppliers > 1 AND size(flag_set) > 1").select("l_partkey", "n", "suppliers", F.size("flag_set").cast("long").alias("flags"), F.array_join("flag_set", "|").alias("flag_list"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans_anti(spark, d):
    return joins.orphans(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_quantity AS BIGINT) IS DISTINCT FROM CAST(p_size AS BIGINT)")
def theta_conflict(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("size_a"))
    right = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("long").alias("size_b"))
    return joins.conflicts(left, right, ["p_partkey"], [("size_a", "size_b")]).select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"), "p_retailprice")


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS canonical, string_agg(doc_id, ',' ORDER BY CAST(doc_id AS BIGINT)) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, canonical LIMIT 10")
def dup_by_hash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    top = catalog.repeated(rows, ["sha"]).join(rows.groupBy("sha").agg(F.min("doc_id").alias("canonical"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids")), "sha")
    return top.select("sha", "n", "canonical", "ids").orderBy(F.desc("n"), "canonical").limit(10)


@query("""WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS n, l_partkey || '-' || l_suppkey || '-' || year(l_shipdate) || '-' || quarter(l_shipdate) AS e FROM lineitem),
p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (e)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def dup_components(spark, d):
    """Orders of the same part from the same supplier in one quarter."""
    key = F.concat_ws("-", "l_partkey", "l_suppkey", F.year("l_shipdate"), F.quarter("l_shipdate"))
    return graph.components(table(spark, d, "lineitem").withColumn("key", key), "l_orderkey", "key")


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def union_inventory(spark, d):
    legs = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return manifest.inventory(*legs).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'missing' AS state FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) UNION ALL SELECT s_suppkey, 'present' FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def set_difference(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    missing, present = manifest.completeness(table(spark, d, "supplier").select("s_suppkey"), used, "s_suppkey")
    return missing.withColumn("state", F.lit("missing")).unionByName(present.withColumn("state", F.lit("present")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_path(spark, d):
    rows = table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return rows.where("k > 90")


@query("""SELECT o_orderkey, unnest(list_distinct([l_returnflag, l_linestatus])) AS flag FROM (SELECT DISTINCT o_orderkey, l_returnflag, l_linestatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def unnest_lateral(spark, d):
    # Few bytes hold many keys, so lines are dealt out by number and not by size: a task's distinct keys stay a share of them.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").repartition(n, "l_orderkey")
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_returnflag", "l_linestatus").distinct()
    return rows.select("o_orderkey", F.explode(F.array_distinct(F.array("l_returnflag", "l_linestatus"))).alias("flag"))


@query("""WITH o AS (SELECT o_custkey AS c_custkey, coalesce(string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus), '') AS o_orderstatus, coalesce(string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority), '') AS o_orderpriority FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS c_custkey, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
j AS (SELECT c_custkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(l_returnflag, '') AS l_returnflag FROM customer LEFT JOIN o USING (c_custkey) LEFT JOIN l USING (c_custkey))
SELECT *, concat_ws('|', CASE WHEN l_returnflag = '' THEN 'l_returnflag' END, CASE WHEN o_orderstatus = '' THEN 'o_orderstatus' END) AS missing_fields, l_returnflag <> '' AND o_orderstatus <> '' AS parse_ready FROM j""")
def manifest_fan_in(spark, d):
    orders = table(spark, d, "orders")
    lines = orders.select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = manifest.fan_in(table(spark, d, "customer").select("c_custkey"), "c_custkey", [(orders, "o_custkey", ["o_orderstatus", "o_orderpriority"]), (lines, "o_custkey", ["l_returnflag"])])
    return manifest.readiness(out, ["o_orderstatus", "l_returnflag"])


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'balance' END AS a, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END AS b FROM customer)
SELECT field, count(*) AS n FROM (SELECT unnest([a, b]) AS field FROM m) WHERE field IS NOT NULL GROUP BY 1""")
def missing_histogram(spark, d):
    rows = table(spark, d, "customer").select(F.concat_ws("|", F.when(F.col("c_acctbal") < 0, "balance"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment")).alias("missing_fields"))
    return manifest.missing_histogram(rows)


@query(r"""SELECT page_id, concat(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)), regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1),
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS url_key
FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND p NOT LIKE 'utm\_%' ESCAPE '\')) AS q FROM pages)""")
def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_key_plain(F.col("url")).alias("url_key"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: (url_decode(replace(split_part(x, '=', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' ')))) AS pairs FROM pages),
k AS (SELECT *, list_sort(list_filter(pairs, lambda x: NOT lower(x[1]) IN ('spm', 'from') AND NOT starts_with(lower(x[1]), 'utm_'))) AS kept FROM p)
SELECT page_id, lower(scheme) || '://' || lower(host) || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') ELSE '' END AS url_key FROM k""")
def url_normalise_exact(spark, d):
    """The same with parameters decoded and encoded again."""
    return table(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query("""WITH k AS (SELECT DISTINCT 'N' || chr(CAST(65 + c_nationkey AS INTEGER)) AS prefix, o_orderkey // 16 AS num FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT prefix, num, lag(num) OVER (PARTITION BY prefix ORDER BY CAST(num AS VARCHAR)) AS b FROM k)
SELECT prefix, prefix || lpad(CAST(n AS VARCHAR), CAST(greatest(4, len(CAST(n AS VARCHAR))) AS INTEGER), '0') AS missing FROM (SELECT prefix, unnest(generate_series(b + 1, num - 1)) AS n FROM g WHERE num > b + 1)""")
def sequence_gaps(spark, d):
    rows = _archives(spark, d).select(F.concat(F.lit("N"), F.chr(F.col("c_nationkey") + 65), F.floor(F.col("o_orderkey") / 16).cast("string")).alias("code"))
    return sequences.sequence_gaps(rows, "code")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark, d):
    return sequences.forward_fill(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("event_type") == "purchase", "filled").select("event_id", "user_id", "filled")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, coalesce(min(CASE WHEN event_type <> 'error' THEN r END) - 1, count(*)) AS streak FROM r WHERE r <= 20 GROUP BY 1""")
def failure_streak(spark, d):
    return sequences.leading_run(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error")


@query("""WITH r AS (SELECT *, row_number() OVER w AS n, event_type IN ('view', 'click') AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, sum(CASE WHEN k THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS f FROM r),
c AS (SELECT *, sum(CASE WHEN k THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, f ORDER BY n) AS c FROM f),
e AS (SELECT *, min(CASE WHEN c >= 3 THEN n END) OVER (PARTITION BY user_id) AS e FROM c)
SELECT event_id, user_id FROM e WHERE e IS NULL OR n <= e""")
def early_stop(spark, d):
    return sequences.until_streak(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click")).select("event_id", "user_id")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM conversations")
def block_build(spark, d):
    return sequences.islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "block")


@query("SELECT conv_id, turn, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_new FROM conversations")
def header_changes(spark, d):
    return sequences.changed(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["role"]).select("conv_id", "turn", "is_new")


@query("""WITH l AS (SELECT l_orderkey AS code, sum(l_quantity * l_discount) AS expected FROM lineitem WHERE l_orderkey % 17 > 0 GROUP BY 1)
SELECT o_orderkey AS code, CASE WHEN price IS NOT NULL THEN CAST(round(coalesce(expected, 0), 2) AS DOUBLE) END AS expected,
  CASE WHEN price IS NULL THEN 'skipped' WHEN abs(price - coalesce(expected, 0)) > 5.0 THEN 'BASE_PRICE_MISMATCH' ELSE 'ok' END AS issue
FROM (SELECT *, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice / 10000 END AS price FROM orders) LEFT JOIN l ON code = o_orderkey""")
def price_check(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("code"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice") / 10000).alias("base_price"))
    lines = table(spark, d, "lineitem").where("l_orderkey % 17 > 0").select(F.col("l_orderkey").alias("code"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("price"))
    return quality.price_check(items, lines, 5.0).select("code", F.when(F.col("base_price").isNotNull(), F.round("expected", 2)).alias("expected"), "issue")


@query("""SELECT row_no, unnest(list_filter([CASE WHEN unit = '' THEN 'no_unit' END, CASE WHEN b IS NULL THEN 'no_price' END, CASE WHEN b <= 0 THEN 'not_positive' END, CASE WHEN name = '螺纹钢 HRB400' AND b < 1000 THEN 'steel_too_cheap' END, CASE WHEN a <> 0 AND b < a THEN 'tax_below_net' END], lambda x: x IS NOT NULL)) AS risk
FROM (SELECT o_orderkey AS row_no, CASE o_orderkey % 3 WHEN 0 THEN '螺纹钢 HRB400' WHEN 1 THEN '不锈钢管' ELSE '砂' END AS name, round(o_totalprice / 100, 2) AS a, CASE WHEN o_custkey % 19 > 0 THEN o_orderkey % 2500 - 10 END AS b, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 't' END AS unit FROM orders)""")
def risk_rows(spark, d):
    key = F.col("o_orderkey")
    gross = F.when(F.col("o_custkey") % 19 > 0, F.format_number(key % 2500 - 10, 2)).otherwise("")
    name = F.when(key % 3 == 0, "螺纹钢 HRB400").when(key % 3 == 1, "不锈钢管").otherwise("砂")
    rows = table(spark, d, "orders").select(key.alias("row_no"), name.alias("name"), F.when(F.col("o_orderstatus") == "P", "").otherwise("t").alias("unit"), F.round(F.col("o_totalprice") / 100, 2).cast("string").alias("price"), gross.alias("price_with_tax"))
    return quality.price_risks(rows)


@query("""WITH g AS (SELECT DISTINCT p_name AS name, unnest(list_transform(range(1, len(p_name)), lambda i: substring(p_name, i, 2))) AS gram FROM part),
n AS (SELECT name, count(*) AS size FROM g GROUP BY 1), r AS (SELECT DISTINCT p_type, p_brand, p_name FROM part), c AS (SELECT DISTINCT p_type, p_name FROM part),
h AS (SELECT a.name AS x, b.name AS y, count(*) AS shared FROM g a JOIN g b USING (gram) GROUP BY ALL),
s AS (SELECT p_brand || '/' || r.p_type || '/' || r.p_name AS id, c.p_name AS candidate_id, 0.8::DOUBLE * (shared::DOUBLE / greatest(m.size, k.size)) + 0.2::DOUBLE * 0.5::DOUBLE AS score
  FROM r JOIN c ON r.p_type = c.p_type AND r.p_name <> c.p_name JOIN h ON x = r.p_name AND y = c.p_name JOIN n m ON m.name = x JOIN n k ON k.name = y)
SELECT id, coalesce(candidate_id, other) AS candidate_id, coalesce(score, CASE WHEN other IS NOT NULL THEN 0.1 ELSE 0 END) AS score, coalesce(score >= 0.6, FALSE) AS matched
FROM (SELECT p_brand || '/' || p_type || '/' || p_name AS id, (SELECT min(c.p_name) FROM c WHERE c.p_type = r.p_type AND c.p_name <> r.p_name) AS other FROM r)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id) AS r FROM s) WHERE r = 1) USING (id)""")
def ngram_align(spark, d):
    """Every part of every brand with the most similar other name of its type."""
    part = table(spark, d, "part")
    left = part.select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit")).distinct()
    right = part.select(F.col("p_name").alias("candidate_id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.lit("").alias("unit")).distinct()
    return joins.aligned(left, right, 0.6, others=True)


@query("""SELECT n_name, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(*) FILTER (o_orderstatus = 'P') AS n_partial, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def conditional_counts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    state = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return rows.groupBy("n_name").agg(state("O").alias("n_open"), state("F").alias("n_final"), state("P").alias("n_partial"), F.count("*").alias("n"), F.count_distinct(F.year("o_orderdate")).alias("years"))


@query("""SELECT n_name, count(*) FILTER (y = 1995) AS "1995", count(*) FILTER (y = 1996) AS "1996", count(*) FILTER (y = 1997) AS "1997", count(*) FILTER (y = 1998) AS "1998", count(*) FILTER (y = 1999) AS "1999", count(*) FILTER (y = 2000) AS "2000", count(*) FILTER (y = 2001) AS "2001"
FROM (SELECT n_name, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def period_pivot(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").pivot("y", list(range(1995, 2002))).count().na.fill(0)


@query("SELECT source, count(*) AS n, count(l.doc_id) AS n_labelled, coalesce(sum(toxic), 0) AS n_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def completeness(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k"), "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("k").alias("n_labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_at, CASE user_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS policy FROM events GROUP BY 1),
t AS (SELECT *, last_at + INTERVAL 8 HOUR AS here, TIMESTAMP '2024-01-31 10:00:00' + INTERVAL 8 HOUR AS now FROM l)
SELECT user_id, policy, CASE policy WHEN 'daily' THEN CAST(here AS DATE) <> CAST(now AS DATE) WHEN 'weekly' THEN date_diff('day', CAST(here AS DATE), CAST(now AS DATE)) >= 7 ELSE strftime(here, '%Y-%m') <> strftime(now, '%Y-%m') END AS is_due FROM t""")
def due_sources(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    policy = F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly")), (F.col("user_id") % 3 + 1).cast("int"))
    now = F.lit("2024-01-31 10:00:00").cast("timestamp")
    return last.withColumn("policy", policy).select("user_id", "policy", periods.due(F.col("policy"), F.col("last_at").cast("timestamp"), now).alias("is_due"))


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' AND NOT contains(text, 'License') AND contains(text, 'the') AND (contains(text, 'stupid') OR contains(text, 'with'))")
def keyword_predicate(spark, d):
    return table(spark, d, "documents").where(catalog.keyword(F.col("text"), ["the"], ["stupid", "with"], ["License"])).select("doc_id")


@query("""SELECT o_orderkey AS key, CASE WHEN q IS NULL THEN 'missing' WHEN q <> o_custkey % 50 + 1 THEN 'mismatch' ELSE 'ok' END AS issue
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def storage_audit(spark, d):
    assets = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 50 + 1).alias("expected"))
    objects = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_quantity").cast("long").alias("actual"))
    return manifest.storage_audit(assets, objects).select("key", "issue")


@query("""WITH f AS (SELECT o_orderkey AS key, o_orderstatus AS sha256 FROM orders), k AS (SELECT l_orderkey AS key, min(l_linestatus) AS old FROM lineitem GROUP BY 1)
SELECT key, CASE WHEN old IS NULL THEN 'ingest' WHEN old = sha256 THEN 'already_ingested' ELSE 'hash_conflict' END AS action FROM f LEFT JOIN k USING (key)""")
def seed_plan(spark, d):
    known = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("sha256"))
    return ingest.seed_plan(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("sha256")), known)


@query("""SELECT event_id, CASE WHEN value >= 100 THEN 'dead' ELSE 'retry' END AS next, least(60 * CAST(pow(2, CAST(floor(value / 20) AS INTEGER)) AS BIGINT), 14400) AS wait FROM events WHERE event_type = 'error'""")
def retry_backoff(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'")
    return rows.select("event_id", F.when(F.col("value") >= 100, "dead").otherwise("retry").alias("next"), periods.backoff_seconds(F.floor(F.col("value") / 20).cast("int")).alias("wait"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m') AS period, l_extendedprice, l_quantity FROM lineitem)
SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM a JOIN a b ON a.l_partkey = b.l_partkey AND a.period = b.period AND a.l_suppkey <> b.l_suppkey AND a.l_orderkey < b.l_orderkey
WHERE a.l_extendedprice = b.l_extendedprice OR a.l_quantity = b.l_quantity""")
def cross_source_duplicates(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", _month("l_shipdate").alias("period"), "l_extendedprice", "l_quantity")
    return joins.duplicates_across(rows, "l_suppkey", ["l_partkey", "period"], ["l_extendedprice", "l_quantity"], "l_orderkey")


@query("""WITH e AS (SELECT o_orderkey AS id, c_nationkey AS nation, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS cust FROM orders JOIN customer ON o_custkey = c_custkey),
s1 AS (SELECT c_custkey, c_name AS owner FROM customer WHERE c_acctbal > 0), s2 AS (SELECT n_nationkey, n_name AS owner FROM nation WHERE n_regionkey <> 0)
SELECT id, coalesce(s1.owner, s2.owner) AS owner, CASE WHEN s1.owner IS NOT NULL THEN 'exact' WHEN s2.owner IS NOT NULL THEN 'province' ELSE 'none' END AS match_kind FROM e LEFT JOIN s1 ON cust = c_custkey LEFT JOIN s2 ON nation = n_nationkey""")
def cascading_match(spark, d):
    rows = _archives(spark, d).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("nation"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("cust"))
    exact = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("owner"))
    wide = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("owner"))
    return joins.cascade(rows, [("exact", ["cust"], exact), ("province", ["nation"], wide)], "owner").select("id", "owner", "match_kind")


@query("SELECT l_partkey AS material, min(l_discount) AS low, quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.5) AS median, quantile_cont(l_discount, 0.75) AS q3, max(l_discount) AS high FROM (SELECT l_partkey, round(l_quantity) AS l_discount FROM lineitem) GROUP BY 1")
def price_five_numbers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("material"), F.round("l_quantity").alias("v"))
    return quality.five_numbers(rows, ["material"], "v")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return feeds.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM h GROUP BY user_id, k""")
def session_window(spark, d):
    return feeds.sessions(table(spark, d, "events"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 2""")
def earliest_two(spark, d):
    from pyspark.sql import Window

    rows = catalog.first_per(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 2)
    return rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


_GAPS = """
WITH o AS (SELECT c_nationkey AS region_code, strftime(o_orderdate, '%Y-%m') AS period, * FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT region_code, period, count(DISTINCT o_orderkey) AS n FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY ALL),
e AS (SELECT region_code, period FROM a UNION SELECT region_code, period FROM o WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'),
t AS (SELECT * FROM (SELECT region_code, period, o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'PARSE_ERROR' WHEN c_mktsegment = 'MACHINERY' THEN 'HOST_UNREACHABLE' END AS error_code,
  row_number() OVER (PARTITION BY region_code, period ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) WHERE r = 1),
b AS (SELECT region_code, min(period) AS lo, max(period) AS hi FROM e GROUP BY 1),
s AS (SELECT s_nationkey AS region_code, bool_or(s_acctbal > 0) AS act, bool_or(s_acctbal > 9500) AS blk FROM supplier GROUP BY 1),
c AS (SELECT region_code, period FROM e UNION SELECT region_code, period FROM t),
f AS (SELECT c.*, coalesce(n, 0) AS archives, e.period IS NOT NULL AS cov, coalesce(act, false) AS act, coalesce(blk, false) AS blk, coalesce(c.period > hi, false) AS later, coalesce(c.period < lo, false) AS earlier, task_id, status, error_code
  FROM c LEFT JOIN a USING (region_code, period) LEFT JOIN e USING (region_code, period) LEFT JOIN t USING (region_code, period) LEFT JOIN b USING (region_code) LEFT JOIN s USING (region_code)),
g AS (SELECT *, CASE WHEN cov THEN NULL WHEN blk OR NOT act THEN 'no_source' WHEN later THEN 'not_published' WHEN status = 'failed' THEN 'failed' ELSE 'not_attempted' END AS gap_reason FROM f)
SELECT region_code, period, archives, CASE WHEN cov THEN 'covered' WHEN blk OR later OR earlier {waits} THEN 'pending_verify' ELSE 'missing' END AS gap_type, gap_reason,
  CASE WHEN {failed} THEN CASE error_code WHEN 'PARSE_ERROR' THEN 'parse_error' WHEN 'HOST_UNREACHABLE' THEN 'host_unreachable' END END AS failed_stage,
  CASE WHEN cov THEN 'in_lake' WHEN status = 'pending' THEN 'queued' WHEN status = 'failed' THEN 'failed' ELSE 'missing' END AS cell_status, coalesce(gap_reason IN ('failed', 'not_attempted'), false) AS actionable, task_id, status AS task_status FROM g"""


def _gaps(spark: SparkSession, d: str, compat: bool) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("region_code"), "c_mktsegment")
    o = table(spark, d, "orders").withColumn("period", _month("o_orderdate")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    archives = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("region_code", "period", F.col("o_orderkey").alias("archive_id"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    error = F.when(F.col("c_mktsegment") == "BUILDING", "PARSE_ERROR").when(F.col("c_mktsegment") == "MACHINERY", "HOST_UNREACHABLE")
    tasks = o.where("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')").select("region_code", "period", F.col("o_orderkey").alias("task_id"), status.alias("status"), error.alias("error_code"), F.col("o_orderdate").alias("created_at"))
    sources = table(spark, d, "supplier").select(F.col("s_nationkey").alias("region_code"), (F.col("s_acctbal") > 0).alias("is_active"), (F.col("s_acctbal") > 9500).alias("is_blocked"))
    return coverage.gap_view(archives, o.where("o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'"), tasks, sources, compat)


@query(_GAPS.format(waits="", failed="gap_reason = 'failed'"))
def gap_view(spark, d):
    return _gaps(spark, d, False)


@query(_GAPS.format(waits="OR NOT act", failed="status = 'failed'"))
def gap_view_compat(spark, d):
    return _gaps(spark, d, True)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) THEN l_returnflag = 'R'
  ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 END AS is_primary FROM lineitem""")
def representation_roles(spark, d):
    out = catalog.representation_roles(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") == "R")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "is_primary")


@query("""WITH r AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderpriority AS row_code, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT year, row_code, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS statuses FROM (SELECT year, row_code, o_orderstatus, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL)
SELECT year, row_code, count(*) AS archives, string_agg(id, ',' ORDER BY id) AS ids, string_agg(c_name, ',' ORDER BY c_name, id) AS titles, string_agg(o_orderstatus, ',' ORDER BY c_name, id) AS title_statuses, any_value(statuses) AS statuses
FROM r JOIN h USING (year, row_code) GROUP BY ALL""")
def book_cells(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("archive_id"), F.col("c_name").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("row_code"), F.col("o_orderstatus").alias("parse_status"))
    out = coverage.book_cells(rows)
    shown = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("year", "row_code", "archives", *[F.array_join(a, ",").alias(b) for a, b in (("archive_ids", "ids"), ("titles", "titles"), ("title_statuses", "title_statuses"))], shown.alias("statuses"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS whole FROM documents),
s AS (SELECT doc_id, whole, list_filter(list_transform(string_split_regex(whole, '{notes.NOTE_START}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 5) AS parts FROM w WHERE whole <> ''),
u AS (SELECT doc_id, CAST(i AS INTEGER) AS note_no, parts[i + 1] AS text, true AS cut FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM s) UNION ALL SELECT doc_id, 0, whole, false FROM s WHERE len(parts) = 0)
SELECT doc_id, note_no, CASE WHEN NOT cut THEN 'other' WHEN regexp_matches(text, '{notes.SCOPE}') THEN 'scope' WHEN regexp_matches(text, '{notes.RULE}') THEN 'calc_rule' ELSE 'other' END AS kind, text FROM u""")
def note_split(spark, d):
    return notes.notes(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH m AS (SELECT l_partkey, year(l_shipdate) AS year, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL)
SELECT l_partkey, year, round(mean, 6) AS mean, lag(year) OVER w AS before, round((mean / lag(mean) OVER w - 1) * 100, 6) AS change_pct FROM m WINDOW w AS (PARTITION BY l_partkey ORDER BY year)""")
def period_change(spark, d):
    out = quality.period_changes(table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")), ["l_partkey"], "year", "l_quantity")
    return out.select("l_partkey", "year", F.round("mean", 6).alias("mean"), "before", F.round("change_pct", 6).alias("change_pct"))


@query("""WITH k AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS h FROM lineitem GROUP BY ALL) JOIN k USING (l_orderkey) WHERE h = n""")
def evidence_intersection(spark, d):
    """Return flags that all lines of an order have."""
    return graph.shared_by_all(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL), k AS (SELECT upper(sha) AS sha, min(doc_id) AS canonical FROM s GROUP BY 1)
SELECT doc_id, canonical FROM s JOIN k ON substring(lower(k.sha), 1, 12) = substring(s.sha, 1, 12)""")
def hash_prefix_join(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    known = rows.groupBy(F.upper("sha").alias("known_sha")).agg(F.min("doc_id").alias("canonical"))
    return joins.by_hash_prefix(rows, "sha", known, "known_sha").select("doc_id", "canonical")


@query("""WITH f AS (SELECT o_custkey AS key, max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS key, max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT key, CASE WHEN f.n IS NULL THEN 'added' WHEN o.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM f FULL JOIN o USING (key) WHERE f.n IS DISTINCT FROM o.n OR f.top IS DISTINCT FROM o.top""")
def row_diff(spark, d):
    side = lambda x: table(spark, d, "orders").where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))
    return joins.full_diff(side("F"), side("O"), "key", ["top", "n"])


@query("""WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT c_custkey AS source_id, count(*) FILTER (e.event_type = 'view') AS pending_count, count(*) FILTER (e.event_type = 'click') AS running_count, count(*) FILTER (e.event_type = 'purchase') AS done_count, count(*) FILTER (e.event_type = 'error') AS failed_count,
  any_value(CASE l.event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END) AS last_status
FROM customer LEFT JOIN events e ON c_custkey = e.user_id LEFT JOIN l ON c_custkey = l.user_id AND l.r = 1 GROUP BY 1""")
def source_dashboard(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in (("view", "pending"), ("click", "running"), ("purchase", "done"), ("error", "failed")) for x in kv])
    tasks = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("task_id"), kinds[F.col("event_type")].alias("status"), F.lit(None).cast("string").alias("error_code"), F.col("ts").alias("at"))
    return ingest.dashboard(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), tasks).drop("last_error")


@query("""WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS n, l_partkey || '-' || l_suppkey || '-' || year(l_shipdate) || '-' || quarter(l_shipdate) AS e FROM lineitem),
p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (e)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a AS archive_id, min(b) AS component FROM r GROUP BY 1),
f AS (SELECT l_orderkey AS archive_id, bool_and(l_quantity > 10) AS found FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
o AS (SELECT o_orderkey AS archive_id, o_orderstatus = 'F' AS has_mount, o_orderpriority = '5-LOW' AS rebuilt, o_totalprice > 200000 AS score, o_orderdate AS made, found FROM orders LEFT JOIN f ON o_orderkey = archive_id),
g AS (SELECT *, count(*) OVER (PARTITION BY component) AS size, first_value(archive_id) OVER w AS canonical, first_value(has_mount OR coalesce(found, false)) OVER w AS ready FROM m JOIN o USING (archive_id)
  WINDOW w AS (PARTITION BY component ORDER BY has_mount DESC, rebuilt, score DESC, made, archive_id DESC)),
x AS (SELECT o.archive_id, o.has_mount, o.found, size > 1 AND ready AND canonical <> archive_id AS gone, canonical FROM o LEFT JOIN g USING (archive_id))
SELECT archive_id, CASE WHEN gone THEN 'withdraw_duplicate' WHEN has_mount THEN 'remove_redundant_orphan_reference' WHEN found THEN 'relink_orphan' ELSE 'manual_review' END AS action, CASE WHEN gone THEN canonical END AS canonical_id
FROM x WHERE gone OR found IS NOT NULL""")
def cleanup_actions(spark, d):
    orders = table(spark, d, "orders")
    archives = orders.select(F.col("o_orderkey").alias("archive_id"), (F.col("o_orderstatus") == "F").alias("has_mount"), (F.col("o_orderpriority") == "5-LOW").alias("is_rebuilt"), (F.col("o_totalprice") > 200000).cast("int").alias("status_score"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    orphans = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("archive_id"), (F.col("l_quantity") > 10).cast("int").alias("candidates"))
    return cleanup.actions(dup_components(spark, d), archives, orphans)


@query("""SELECT count(DISTINCT o_orderkey) AS raw_total, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R", count(DISTINCT o_orderkey) = count(l_returnflag) AS invariant_ok
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def reconciliation(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.max("l_returnflag").alias("status"))
    return cleanup.reconciliation(table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id")), one, ["A", "N", "R"])


@query("""SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def delete_impact(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1")
    return cleanup.impact(gone, "n_nationkey", {t: (table(spark, d, t), f"{t[0]}_nationkey") for t in ("customer", "supplier")})


@query("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, sha256(text) AS blob_hash, n_chars AS size FROM documents), b AS (SELECT sha256(text) AS blob_hash, CAST(len(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND lang <> 'fr')
SELECT 'no_hash' AS problem, count(*) AS n FROM a WHERE coalesce(blob_hash, '') = '' UNION ALL SELECT 'unknown_hash', count(*) FROM a WHERE blob_hash <> '' AND blob_hash NOT IN (SELECT blob_hash FROM b)
UNION ALL SELECT 'repeated_blob', count(*) FROM (SELECT blob_hash FROM b GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'other_size', count(*) FROM a JOIN b USING (blob_hash) WHERE a.size IS DISTINCT FROM b.size""")
def blob_integrity(spark, d):
    docs = table(spark, d, "documents").withColumn("blob_hash", F.sha2("text", 256))
    blobs = docs.where("text IS NOT NULL AND lang <> 'fr'").select("blob_hash", F.char_length("text").cast("long").alias("size"))
    return cleanup.integrity(docs.select(F.col("doc_id").cast("string").alias("file_id"), "blob_hash", F.col("n_chars").alias("size")), blobs)


@query("""WITH o AS (SELECT c_nationkey AS region_code, strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS p, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT region_code, period, CASE WHEN bool_or(p = '1-URGENT') THEN 'covered' ELSE 'missing' END AS status FROM o GROUP BY ALL),
s AS (SELECT s_nationkey AS region_code, min(s_suppkey) AS source_id FROM supplier WHERE s_acctbal > 0 GROUP BY 1), t AS (SELECT DISTINCT source_id, period, true AS busy FROM o JOIN s USING (region_code) WHERE p = '2-HIGH' AND s = 'O')
SELECT n_nationkey AS region_code, w.period, s.source_id, CASE WHEN status IS NULL THEN 'coverage_cell_not_found' WHEN status = 'covered' THEN 'covered' WHEN s.source_id IS NULL THEN 'source_not_found' WHEN busy THEN 'pending_or_running_exists' ELSE 'task' END AS outcome
FROM nation, (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS period) w LEFT JOIN c ON c.region_code = n_nationkey AND c.period = w.period LEFT JOIN s ON s.region_code = n_nationkey LEFT JOIN t ON t.source_id = s.source_id AND t.period = w.period""")
def backfill_plan(spark, d):
    o = _archives(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").withColumnRenamed("c_nationkey", "region_code")
    cells = o.groupBy("region_code", "period").agg(F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), "covered").otherwise("missing").alias("status"))
    sources = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("region_code"), F.col("s_suppkey").alias("source_id"))
    serving = sources.groupBy("region_code").agg(F.min("source_id").alias("source_id"))
    tasks = o.where("o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'").join(serving, "region_code").select("source_id", "period", F.lit("pending").alias("status"))
    months = spark.range(1).select(F.explode(periods.months_between(F.lit("1995-01"), F.lit("2001-12"))).alias("period"))
    return coverage.backfill_plan(coverage.spine(table(spark, d, "nation").select(F.col("n_nationkey").alias("region_code")), months), cells, sources, tasks)


@query("""WITH r AS (SELECT c.conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations c),
i AS (SELECT * FROM (SELECT conv_id, block, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS n FROM r WHERE role = 'user' AND contains(text, 'the')) WHERE n = 1),
e AS (SELECT conv_id, block, min(turn) AS stop FROM r WHERE role = 'system' GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS province, turn AS row_no, role AS kind, text AS name FROM r JOIN i USING (conv_id, block) LEFT JOIN e USING (conv_id, block) WHERE role <> 'system' AND (stop IS NULL OR turn < stop)""")
def keyword_blocks(spark, d):
    """Turns of users that name a word, with the turns that follow; system turns stand for sections."""
    rows = table(spark, d, "conversations").distinct()
    kind = F.when(F.col("role") == "user", comparison.ITEM).when(F.col("role") == "system", comparison.SECTION).otherwise(F.col("role"))
    rows = rows.select(F.col("conv_id").cast("string").alias("province"), F.col("turn").alias("row_no"), kind.alias("kind"), F.col("text").alias("code"), F.col("text").alias("name"))
    out = comparison.item_hits(rows, catalog.keyword(F.col("name"), ["the"]), F.lit(1), 1)
    return out.select("province", "row_no", F.when(F.col("kind") == comparison.ITEM, "user").otherwise(F.col("kind")).alias("kind"), "name")


# The catalogue's eight tables out of the driver's, as DuckDB views and as frames.
_CATALOGUE_SQL = """
WITH blob AS (SELECT 'h' || c_custkey AS blob_hash, CASE WHEN c_custkey % 10 = 0 THEN 'other' ELSE 'cost-raw' END AS bucket, 'objects/' || c_custkey % 7 || '/' || c_custkey || '.PDF' AS object_key, CASE WHEN c_custkey % 3 > 0 THEN 'application/pdf' END AS mime, c_custkey * 10 AS size FROM customer),
asset AS (SELECT o_orderkey AS file_id, 'h' || o_custkey AS blob_hash, 'F' || o_orderkey % 5 AS file_name, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
event AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_orderkey AS file_id, 'T' || l_suppkey AS task_id, CASE WHEN l_partkey % 3 = 0 THEN 'N' || l_partkey % 30 END AS source_id, CASE WHEN l_linenumber = 1 THEN ' ' || l_returnflag || ' ' ELSE ' ' END AS original_name, 'B' || l_linenumber AS batch_id, strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS seen_at FROM lineitem WHERE l_linenumber <= 2),
task AS (SELECT 'T' || s_suppkey AS task_id, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_nationkey END AS source_id, 'b' || s_suppkey % 4 AS batch_id, CASE WHEN s_suppkey % 5 = 0 THEN '2024-0' || (1 + s_suppkey % 9) END AS period_start FROM supplier WHERE s_suppkey % 7 > 0),
mount AS (SELECT 'A' || o_custkey % 120 AS archive_id, o_orderkey AS file_id, o_orderpriority AS file_role FROM orders WHERE o_orderstatus = 'F'),
archive AS (SELECT 'A' || c_custkey AS archive_id, c_name AS title, c_nationkey AS region_code, CASE WHEN c_custkey % 2 = 0 THEN 'cost_info' ELSE 'quota' END AS domain_type, 'N' || c_nationkey AS source_id, CASE WHEN c_custkey % 4 = 0 THEN '2024-02' END AS period FROM customer WHERE c_custkey < 100),
source AS (SELECT 'N' || n_nationkey AS source_id, n_name AS name, 'P' || n_regionkey AS province, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS city FROM nation),
region AS (SELECT n_nationkey AS region_code, 'R' || n_regionkey AS province_name, CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_nationkey ELSE '' END AS region_name FROM nation WHERE n_nationkey < 20),
"""


def _catalogue(spark, d) -> dict[str, DataFrame]:
    of = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    c, none = F.col, F.lit(None).cast("string")
    customer, orders, supplier, nation = (table(spark, d, t) for t in ("customer", "orders", "supplier", "nation"))
    key = c("c_custkey")
    return {
        "blobs": customer.select(of("h", key).alias("blob_hash"), F.when(key % 10 == 0, "other").otherwise("cost-raw").alias("storage_bucket"), F.concat(of("objects/", key % 7), of("/", key), F.lit(".PDF")).alias("blob_storage_key"), F.when(key % 3 > 0, "application/pdf").alias("mime_type"), (key * 10).alias("byte_size"), none.alias("etag"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")),
        "assets": orders.select(c("o_orderkey").alias("file_id"), of("h", c("o_custkey")).alias("blob_hash"), of("F", c("o_orderkey") % 5).alias("file_name")),
        "events": table(spark, d, "lineitem").where("l_linenumber <= 2").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("event_id"), c("l_orderkey").alias("file_id"), of("T", c("l_suppkey")).alias("task_id"), F.when(c("l_partkey") % 3 == 0, of("N", c("l_partkey") % 30)).alias("source_id"), F.when(c("l_linenumber") == 1, F.concat(F.lit(" "), c("l_returnflag"), F.lit(" "))).otherwise(" ").alias("original_name"), none.alias("source_url"), of("B", c("l_linenumber")).alias("batch_id"), c("l_shipdate").cast("date").cast("timestamp").alias("ingested_at")),
        "tasks": supplier.where("s_suppkey % 7 > 0").select(of("T", c("s_suppkey")).alias("task_id"), F.when(c("s_suppkey") % 2 == 0, of("N", c("s_nationkey"))).alias("source_id"), of("b", c("s_suppkey") % 4).alias("batch_id"), F.when(c("s_suppkey") % 5 == 0, of("2024-0", c("s_suppkey") % 9 + 1)).alias("period_start"), none.alias("period_end"), none.alias("period_raw")),
        "mounts": orders.where("o_orderstatus = 'F'").select(of("A", c("o_custkey") % 120).alias("archive_id"), c("o_orderkey").alias("file_id"), c("o_orderpriority").alias("file_role")),
        "archives": customer.where("c_custkey < 100").select(of("A", key).alias("archive_id"), c("c_name").alias("title"), c("c_nationkey").alias("region_code"), F.when(key % 2 == 0, "cost_info").otherwise("quota").alias("domain_type"), none.alias("period_kind"), none.alias("publish_date"), none.alias("source_url"), of("N", c("c_nationkey")).alias("source_id"), none.alias("task_id"), none.alias("batch_id"), F.when(key % 4 == 0, "2024-02").alias("period"), none.alias("period_start"), none.alias("period_end"), none.alias("period_raw")),
        "sources": nation.select(of("N", c("n_nationkey")).alias("source_id"), c("n_name").alias("name"), of("P", c("n_regionkey")).alias("province"), F.when(c("n_nationkey") % 2 == 0, c("n_name")).alias("city")),
        "regions": nation.where("n_nationkey < 20").select(c("n_nationkey").alias("region_code"), of("R", c("n_regionkey")).alias("province_name"), F.when(c("n_nationkey") % 3 == 0, of("r", c("n_nationkey"))).otherwise("").alias("region_name")),
    }


@query(_CATALOGUE_SQL + """
j AS (SELECT b.*, a.file_id, a.file_name, e.event_id, e.task_id AS event_task, e.source_id AS event_source, e.original_name, e.batch_id AS event_batch, e.seen_at, t.task_id AS known_task, t.source_id AS task_source, t.batch_id AS task_batch, t.period_start, m.file_role, r.archive_id, r.title, r.region_code, r.domain_type, r.source_id AS archive_source, r.period, coalesce(e.source_id, t.source_id, r.source_id) AS sid
  FROM blob b LEFT JOIN asset a USING (blob_hash) LEFT JOIN event e USING (file_id) LEFT JOIN task t ON t.task_id = e.task_id LEFT JOIN mount m ON m.file_id = a.file_id LEFT JOIN archive r ON r.archive_id = m.archive_id WHERE bucket = 'cost-raw'),
k AS (SELECT j.*, s.source_id AS s_id, s.name AS s_name, s.province AS s_province, s.city AS s_city, g.province_name, g.region_name FROM j LEFT JOIN source s ON s.source_id = sid LEFT JOIN region g USING (region_code)),
v AS (SELECT blob_hash, unnest([('file_ids', CAST(file_id AS VARCHAR)), ('archive_ids', archive_id), ('file_names', file_name), ('original_names', original_name), ('resolved_provinces', province_name), ('resolved_provinces', s_province), ('resolved_regions', region_name), ('resolved_regions', s_city), ('source_provinces', s_province), ('source_cities', s_city),
  ('region_codes', CAST(region_code AS VARCHAR)), ('archive_titles', title), ('domain_types', domain_type), ('file_roles', file_role), ('period_starts', period_start), ('period_starts', period), ('period_raws', title), ('source_names', s_name), ('source_ids', event_source), ('source_ids', archive_source), ('source_ids', s_id), ('task_ids', event_task), ('task_ids', known_task), ('batch_ids', event_batch), ('batch_ids', task_batch), ('ingested_ats', seen_at)]) AS p FROM k),
f AS (SELECT blob_hash, p[1] AS field, string_agg(DISTINCT trim(p[2]), ' | ' ORDER BY trim(p[2])) AS value FROM v WHERE trim(p[2]) <> '' GROUP BY ALL),
w AS (SELECT blob_hash, """ + ", ".join(f"coalesce(max(value) FILTER (field = '{x}'), '') AS {x}" for x in manifest.SET_FIELDS) + """ FROM f GROUP BY 1),
x AS (SELECT blob_hash, bucket, object_key, mime, size, count(DISTINCT file_id) AS files, count(DISTINCT event_id) AS events FROM k GROUP BY ALL),
y AS (SELECT x.*, """ + ", ".join(f"coalesce({x}, '') AS {x}" for x in manifest.SET_FIELDS) + """ FROM x LEFT JOIN w USING (blob_hash))
SELECT 'parse_manifest.v1' AS manifest_schema_version, bucket, object_key, '/nas/' || object_key AS nas_path, blob_hash AS sha256, '.pdf' AS file_ext, coalesce(mime, '') AS mime_type, CAST(size AS VARCHAR) AS byte_size, '' AS etag, '2024-01-01T00:00:00+00:00' AS blob_created_at, CAST(files AS VARCHAR) AS file_asset_count, CAST(events AS VARCHAR) AS ingest_event_count, """ + ", ".join(manifest.SET_FIELDS) + """,
  concat_ws('|', CASE WHEN archive_ids = '' THEN 'archive_ids' END, CASE WHEN original_names || file_names = '' THEN 'original_names' END, CASE WHEN period_starts || period_raws = '' THEN 'period' END, CASE WHEN resolved_regions || region_codes = '' THEN 'region' END) AS missing_fields, CASE WHEN missing_fields = '' THEN 'true' ELSE 'false' END AS parse_ready FROM y""")
def parse_manifest(spark, d):
    """Customers as stored objects, their orders as files, order lines as observations and suppliers as tasks."""
    return manifest.parse_manifest(**_catalogue(spark, d), nas_root="/nas/")
