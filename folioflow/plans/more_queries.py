"""Lists, archives and packages on the driver's tables, with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import filters
from ..session import table
from . import archives, coverage, quality
from .driver_queries import ORACLE_SQL, _archives, _matrix, query


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND coalesce(CASE WHEN o_custkey % 7 > 0 THEN o_orderstatus END, '') <> 'P'")
def excluded_roles(spark, d):
    rows = filters.none_of(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    status = F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderstatus"))
    return rows.where(filters.blank(status) | (status != "P")).select("o_orderkey")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (toxic = 1) IS NOT TRUE")
def not_true(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(~filters.truly(F.col("toxic") == 1)).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#0000001%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_prefix(spark, d):
    rows = table(spark, d, "customer").where(F.startswith("c_name", F.lit("Customer#0000001")))
    return filters.having(rows, "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)")
def dangling_files(spark, d):
    lines = table(spark, d, "lineitem")
    return filters.dangling(table(spark, d, "part"), "p_partkey", [(lines.where("l_quantity > 45"), "l_partkey"), (lines.where("l_returnflag = 'R' AND l_quantity > 30"), "l_partkey")]).select("p_partkey")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_final, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS n_suppliers FROM customer""")
def child_counts(spark, d):
    orders = table(spark, d, "orders")
    rows = filters.child_counts(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", {"n_orders": (orders, "o_custkey"), "n_final": (orders.where("o_orderstatus = 'F'"), "o_custkey")})
    return filters.child_counts(rows, "c_nationkey", {"n_suppliers": (table(spark, d, "supplier"), "s_nationkey")}).select("c_custkey", "n_orders", "n_final", "n_suppliers")


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_23') AND c_mktsegment = 'BUILDING'")
def chip_filters(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, d, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    out = filters.chips(rows, [(table(spark, d, "customer"), "c_custkey"), (nation, "c_nationkey"), (table(spark, d, "region"), "r_regionkey")], {"n_name": ["NATION_1", "NATION_7", "NATION_23"], "c_mktsegment": ["BUILDING"], "r_name": []})
    return out.select("o_orderkey", "n_name")


@query("SELECT n_nationkey AS code, n_name AS name FROM nation WHERE n_name ILIKE '%tion_1%' AND n_nationkey % 4 > 0 AND CAST(n_regionkey AS VARCHAR) = '1'")
def divisions_by_name(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit("city").alias("level"), F.col("n_regionkey").cast("string").alias("parent_code"), (F.col("n_nationkey") % 4 > 0).alias("enabled"))
    return filters.divisions(rows, "city", "1", "TION_1").select("code", "name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def sorted_page(spark, d):
    return filters.listed(table(spark, d, "orders"), "o_orderkey", "o_totalprice", True, 3, 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50")
def random_sample(spark, d):
    """50 orders by the hash of their key: a sample is what is asked for."""
    return filters.sampled(table(spark, d, "orders"), "o_orderkey", 50, 7).select("o_orderkey")


@query("""WITH i AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'late' END AS issue FROM orders WHERE o_orderstatus <> 'F')
SELECT issue, n, first FROM (SELECT issue, count(*) AS n FROM i GROUP BY 1) JOIN (SELECT issue, min(row_no) AS first FROM (SELECT * FROM i ORDER BY row_no DESC LIMIT 20) GROUP BY 1) USING (issue)""")
def capped_issues(spark, d):
    issues = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("row_no"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("late").alias("issue"))
    first, counts = filters.capped(issues, "issue", [F.desc("row_no")], 20)
    return counts.join(first.groupBy("issue").agg(F.min("row_no").alias("first")), "issue")


@query("SELECT sha256(text) AS sha, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def files_by_hash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return filters.files_by_hash(rows, "sha", "doc_id").select("sha", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 DAY END AS planned FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(planned, ts) DESC, r) AS l FROM r WHERE r <= 20) WHERE l = 1""")
def latest_planned(spark, d):
    rows = table(spark, d, "events").withColumn("planned", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 30 days")))
    return filters.latest_of_newest(rows, ["user_id"], "ts", "planned", "event_id").select("user_id", "event_id")


@query("SELECT s_suppkey, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 0 DESC, s_acctbal DESC, s_suppkey) AS preferred, s_suppkey = preferred AS is_preferred FROM supplier")
def preferred_source(spark, d):
    return filters.preferred(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", [F.desc(F.col("s_acctbal") > 0), F.desc("s_acctbal")]).select("s_suppkey", "preferred", "is_preferred")


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey) FILTER (l_returnflag = 'R'), list(l_partkey) FILTER (l_quantity > 25)))), ',') AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def ordered_union(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("b"))
    return rows.select("o_orderkey", F.array_join(filters.ordered_union(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("ids"))


@query("""WITH k AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN 'new ' || c_custkey END AS name, c_mktsegment || '!' AS segment FROM customer WHERE c_custkey % 4 > 0)
SELECT id, coalesce(n.name, k.name) AS name, coalesce(n.segment, k.segment) AS segment, CASE WHEN n.id IS NULL THEN 'kept' WHEN k.id IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM k FULL JOIN n USING (id)""")
def ledger_upsert(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    known = c.where(key % 3 > 0).select(key.alias("id"), F.col("c_name").alias("name"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    new = c.where(key % 4 > 0).select(key.alias("id"), F.when(key % 5 > 0, F.concat(F.lit("new "), key.cast("string"))).alias("name"), F.concat("c_mktsegment", F.lit("!")).alias("segment"))
    return filters.upserted(known, new, ["id"])


@query("""WITH n AS (SELECT o_orderkey AS event_id, 't' || o_custkey % 2 AS tenant, CASE WHEN o_orderkey % 3 = 0 THEN 'quota' ELSE 'cost_info' END AS domain, 'k' || o_custkey AS k, o_orderdate AS made FROM orders WHERE o_orderstatus = 'O'),
t AS (SELECT DISTINCT 't' || o_custkey % 2 AS tenant, CASE WHEN o_orderkey % 3 = 0 THEN 'quota' ELSE 'cost_info' END AS domain, 'k' || o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT event_id, n.tenant AS tenant_code, n.domain AS domain_type, n.k AS business_key, CASE WHEN row_number() OVER (PARTITION BY n.tenant, n.domain, n.k ORDER BY made, event_id) = 1 AND t.k IS NULL THEN 'created' WHEN n.domain = 'cost_info' THEN 'attached' ELSE 'rejected' END AS outcome
FROM n LEFT JOIN t ON n.tenant = t.tenant AND n.domain = t.domain AND n.k = t.k""")
def archive_writes(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("event_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 2).cast("string")).alias("tenant_code"), F.when(key % 3 == 0, "quota").otherwise("cost_info").alias("domain_type"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("business_key"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    return archives.written(rows.where("o_orderstatus = 'P'"), rows.where("o_orderstatus = 'O'"))


def _rebuild(spark, d):
    of = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = _archives(spark, d).withColumn("region", F.lpad((F.col("c_nationkey") * 4000).cast("string"), 6, "0"))
    manifest = o.select(
        of("h", key).alias("sha256"), F.when(key % 29 > 0, of("k", key)).alias("object_key"), F.when(key % 7 == 0, "quota").otherwise("cost_info | quota").alias("domain_types"), F.when(key % 11 > 0, "true").otherwise("false").alias("parse_ready"), of("T", cust % 3).alias("archive_titles"), F.lit("").alias("period_raws"),
        F.col("period").alias("period_starts"), F.lit("").alias("original_names"), F.when(key % 13 > 0, F.col("region")).otherwise("").alias("region_codes"), of("https://x/?id=", cust % 40).alias("source_urls"), F.when(key % 2 == 0, of("S", F.col("c_nationkey"))).otherwise("S1 | S2").alias("source_names"),
    )
    sup = F.col("s_suppkey")
    sources = table(spark, d, "supplier").where("s_suppkey > 0").select(of("s", sup).alias("source_id"), sup.alias("seq"), F.when(sup % 3 > 0, F.lpad((F.col("s_nationkey") * 4000 + F.when(sup % 2 == 0, 0).otherwise(1)).cast("string"), 6, "0")).alias("region_code"), of("S", F.col("s_nationkey")).alias("name"), F.when(sup % 5 == 0, "province").alias("publisher_scope"))
    known = o.where(key % 5 == 0).select(of("s", cust % 10).alias("source_id"), F.col("region").alias("region_code"), "period", of("T", cust % 3).alias("title"), of("HTTPS://X/?id=", cust % 40).alias("source_url"), of("h", key + 5).alias("sha256"))
    mounted = o.where(key % 17 == 0).select(of("h", key).alias("sha256"))
    return archives.rebuild_plan(manifest, sources, known, mounted)


@query("""WITH o AS (SELECT o_orderkey AS key, o_custkey AS cust, c_nationkey AS nat, strftime(o_orderdate, '%Y-%m') AS period, lpad(CAST(c_nationkey * 4000 AS VARCHAR), 6, '0') AS region FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT 'h' || key AS sha256, key % 11 > 0 AND key % 29 > 0 AND key % 13 > 0 AS ready, 'T' || cust % 3 AS title, period, CASE WHEN key % 13 > 0 THEN region END AS region, 'https://x/?id=' || cust % 40 AS url, CASE WHEN key % 2 = 0 THEN 'S' || nat ELSE 'S1' END AS name FROM o WHERE key % 7 > 0),
s AS (SELECT 's' || s_suppkey AS source_id, s_suppkey AS seq, CASE WHEN s_suppkey % 3 > 0 THEN lpad(CAST(s_nationkey * 4000 + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS VARCHAR), 6, '0') END AS region, 'S' || s_nationkey AS name, s_suppkey % 5 = 0 AS of_province FROM supplier WHERE s_suppkey > 0),
a AS (SELECT region, arg_min(source_id, seq) AS a_id FROM s WHERE region IS NOT NULL GROUP BY 1), b AS (SELECT substr(region, 1, 2) AS prefix, arg_min(source_id, CASE WHEN of_province THEN 0 ELSE 1000000 END + seq) AS b_id FROM s WHERE region IS NOT NULL GROUP BY 1), n AS (SELECT name, arg_min(source_id, seq) AS n_id FROM s GROUP BY 1),
j AS (SELECT m.*, coalesce(a_id, b_id, n_id, 'legacy') AS source_id, CASE WHEN a_id IS NOT NULL THEN 'region' WHEN b_id IS NOT NULL THEN 'province' WHEN n_id IS NOT NULL THEN 'name' ELSE 'legacy' END AS match_kind FROM m LEFT JOIN a USING (region) LEFT JOIN b ON prefix = substr(m.region, 1, 2) LEFT JOIN n USING (name)),
k AS (SELECT 's' || cust % 10 AS source_id, region, period, 'T' || cust % 3 AS title, 'https://x/?id=' || cust % 40 AS url, 'h' || key + 5 AS sha256 FROM o WHERE key % 5 = 0)
SELECT sha256, CASE WHEN ready THEN source_id END AS source_id, CASE WHEN ready THEN match_kind END AS match_kind, CASE WHEN NOT ready THEN 'incomplete'
  WHEN EXISTS (SELECT 1 FROM k WHERE k.region = j.region AND k.period = j.period AND k.title = j.title AND k.source_id <> j.source_id AND (k.url = j.url OR k.sha256 = j.sha256)) THEN 'cross_source_duplicate'
  WHEN sha256 IN (SELECT 'h' || key FROM o WHERE key % 17 = 0) THEN 'existing' ELSE 'archive' END AS outcome FROM j""")
def rebuild_plan(spark, d):
    return _rebuild(spark, d)


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_orderdate, l_shipdate, l_linenumber, l_quantity > 40 AS failed FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND l_linestatus = 'O'),
s AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, l_shipdate, l_linenumber, id) AS r FROM f), t AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (ORDER BY r) AS turn FROM s WHERE r <= 300)
SELECT id AS archive_file_id, CASE WHEN failed THEN 'skipped_failed' ELSE 'fetch' END AS outcome FROM t WHERE CASE WHEN failed THEN turn < 80 ELSE turn <= 80 END""")
def pending_fetches(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("archive_file_id"), F.lit("trading").alias("domain_type"), F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "pending").otherwise("done").alias("fetch_status"), F.col("o_orderdate").alias("publish_date"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("sort_order"), (F.col("l_quantity") > 40).alias("failed"))
    return archives.pending_fetches(rows, 80, 300)


@query("""SELECT 'sources' AS section, 'total' AS measure, '' AS value, count(*) AS n FROM supplier UNION ALL SELECT 'sources', 'audit_status', 'ready', count(*) FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'archives', 'total', '', count(*) FROM orders UNION ALL SELECT 'archives', 'channel_type', o_orderpriority, count(*) FROM orders GROUP BY 3 UNION ALL SELECT 'archives', 'status', o_orderstatus, count(*) FROM orders GROUP BY 3
UNION ALL SELECT 'coverage', 'total', '', count(*) FROM customer UNION ALL SELECT 'coverage', 'business_coverage_status', c_mktsegment, count(*) FROM customer GROUP BY 3 UNION ALL SELECT 'coverage', 'source_completeness_status', 'dual_source', count(*) FROM customer UNION ALL SELECT 'tasks', 'total', '', count(*) FROM events UNION ALL SELECT 'tasks', 'status', event_type, count(*) FROM events GROUP BY 3""")
def acceptance_summary(spark, d):
    sources = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 0, "ready").otherwise("").alias("audit_status"))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("channel_type"), F.col("o_orderstatus").alias("status"))
    cells = table(spark, d, "customer").select(F.col("c_mktsegment").alias("business_coverage_status"), F.lit("dual_source").alias("source_completeness_status"))
    return archives.acceptance_summary(sources, rows, cells, table(spark, d, "events").select(F.col("event_type").alias("status")))


@query("""SELECT (SELECT count(*) FROM nation) AS systems, (SELECT count(*) FROM customer) AS archived, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS raw_total, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS linked, count(*) FILTER (event_type = 'error') AS duplicate, count(*) FILTER (event_type = 'purchase') AS invalid, 0 AS ignored FROM events""")
def quota_stats(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("view", "pending", "click", "linked", "error", "duplicate", "purchase", "invalid")])
    return archives.quota_stats(table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id")), table(spark, d, "events").select(names[F.col("event_type")].alias("projection_status")))


@query(r"""WITH r AS (SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) SELECT a.id, b.id AS other_id FROM r a JOIN r b USING (url)""")
def same_url(spark, d):
    rows = table(spark, d, "pages").select(F.lit("t").alias("tenant_code"), F.col("page_id").alias("id"), F.regexp_replace("url", r"[?#].*$", "").alias("source_url"))
    return archives.same_url(rows, rows.withColumn("source_url", F.concat(F.upper(F.regexp_extract("source_url", "^[^:]*", 0)), F.regexp_replace("source_url", "^[^:]*", ""), F.lit("?utm_source=x#y"))))


@query("SELECT s_suppkey AS id, coalesce((SELECT string_agg(b.s_suppkey, ',' ORDER BY b.s_suppkey) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey), '') AS others FROM supplier a")
def edition_siblings(spark, d):
    return archives.siblings(table(spark, d, "supplier"), "s_nationkey", "s_suppkey").select("id", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("""SELECT o_orderkey AS path, CASE WHEN q IS NULL THEN 'missing' WHEN q = o_custkey % 50 THEN 'mirrored' ELSE 'stale' END AS mirror_status FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) ON o_orderkey = l_orderkey""")
def mirror_status(spark, d):
    found = table(spark, d, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_quantity").cast("long").alias("size"))
    return archives.mirror_status(table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 50).alias("size")), found)


@query(r"""SELECT business_coverage_status AS business, source_completeness_status AS sources, CASE WHEN business = 'covered' THEN '已覆盖' WHEN sources = 'source_blocked' THEN '源受阻' WHEN business = 'missing' THEN '缺失' ELSE '待核' END AS label,
  CASE WHEN business = 'covered' THEN CASE WHEN primary_download_url IS NULL THEN 'covered' ELSE 'file' END WHEN sources = 'source_blocked' THEN 'blocked' WHEN business = 'missing' THEN 'missing' ELSE 'pending' END AS kind, count(*) AS n FROM (COVERAGE) GROUP BY ALL""".replace("COVERAGE", ORACLE_SQL["coverage_matrix"]))
def coverage_labels(spark, d):
    business, sources = F.col("business_coverage_status"), F.col("source_completeness_status")
    return _matrix(spark, d).groupBy(business.alias("business"), sources.alias("sources"), archives.state_label(business, sources).alias("label"), archives.cell_kind(business, sources, F.col("primary_download_url")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT coverage_region_code, period, coverage_note FROM (COVERAGE) WHERE coverage_region_code LIKE '1104%' AND CAST(substr(period, 1, 4) AS INTEGER) BETWEEN 1996 AND 1999 AND business_coverage_status = 'covered' AND contains(lower(concat_ws(' ', coverage_region_code, coverage_region_name, period, business_coverage_status, source_completeness_status, coverage_note)), 'note 4')
UNION ALL SELECT coverage_region_code, period, coverage_note FROM (COVERAGE) WHERE period = '1998-02' AND source_completeness_status = 'dual_source'""".replace("COVERAGE", ORACLE_SQL["coverage_matrix"]))
def coverage_filters(spark, d):
    cells = _matrix(spark, d)
    columns = ["coverage_region_code", "period", "coverage_note"]
    first = coverage.filtered_cells(cells, city="110400", years=(1996, 1999), business="covered", query=" NOTE 4 ")
    return first.select(*columns).unionByName(coverage.filtered_cells(cells, period="1998-02", sources="dual_source").select(*columns))


def _items(spark, d):
    number = F.floor(F.col("o_orderkey") / 8)
    code = lambda n: F.concat(F.lit("Q"), F.lpad(n.cast("string"), 5, "0"))
    rows = table(spark, d, "orders").where(number % 7 > 0).groupBy(number.alias("n")).agg(F.max("o_totalprice").alias("price"))
    n = F.col("n")
    items = rows.select(code(n).alias("code"), F.when(n % 19 > 0, F.concat(F.lit("n"), n.cast("string"))).alias("name"), F.when(n % 5 > 0, "m3").otherwise("").alias("unit"), F.when(n % 3 > 0, F.col("price") / 10000).alias("base_price"))
    of = F.floor(F.col("l_orderkey") / 8)
    lines = table(spark, d, "lineitem").where(of % 6 > 0).select(code(of).alias("code"), (F.col("l_partkey") % 50).alias("name"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("price"))
    listed = table(spark, d, "part").where("p_partkey < 49").select(F.col("p_partkey").alias("name"), (F.col("p_size") / 100).alias("price"))
    return items, lines, listed


_QA_SQL = """
WITH i AS (SELECT 'Q' || lpad(CAST(n AS VARCHAR), 5, '0') AS code, CASE WHEN n % 19 > 0 THEN 'n' || n END AS name, CASE WHEN n % 5 > 0 THEN 'm3' ELSE '' END AS unit, CASE WHEN n % 3 > 0 THEN price / 10000 END AS base FROM (SELECT o_orderkey // 8 AS n, max(o_totalprice) AS price FROM orders WHERE o_orderkey // 8 % 7 > 0 GROUP BY 1)),
l AS (SELECT 'Q' || lpad(CAST(l_orderkey // 8 AS VARCHAR), 5, '0') AS code, l_quantity AS q, CASE WHEN l_linenumber > 1 THEN l_discount ELSE p_size / 100 END AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey < 49) ON p_partkey = l_partkey % 50 WHERE l_orderkey // 8 % 6 > 0),
s AS (SELECT code, sum(coalesce(q, 0) * price) AS expected, count(*) FILTER (price IS NULL) AS unpriced FROM l GROUP BY 1),
c AS (SELECT code, CAST(substr(code, 2) AS BIGINT) AS num, lag(CAST(substr(code, 2) AS BIGINT)) OVER (ORDER BY code) AS before FROM i),
q AS (SELECT i.code, 'error' AS level, 'BASE_PRICE_MISMATCH' AS issue FROM i LEFT JOIN s USING (code) WHERE base IS NOT NULL AND coalesce(unpriced, 0) = 0 AND abs(base - coalesce(expected, 0)) > 20
  UNION ALL SELECT 'Q' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, len(CAST(n AS VARCHAR))) AS INTEGER), '0'), 'warning', 'CODE_GAP' FROM (SELECT unnest(generate_series(before + 1, num - 1)) AS n FROM c WHERE num > before + 1)
  UNION ALL SELECT code, 'warning', 'MISSING_UNIT' FROM i WHERE coalesce(unit, '') = '' UNION ALL SELECT code, 'warning', 'EMPTY_RESOURCES' FROM i WHERE base IS NOT NULL AND code NOT IN (SELECT code FROM l) UNION ALL SELECT code, 'error', 'MISSING_NAME' FROM i WHERE coalesce(name, '') = '')
"""


@query(_QA_SQL + "SELECT * FROM q")
def qa_issues(spark, d):
    items, lines, listed = _items(spark, d)
    return quality.qa_issues(items, lines, 20.0, listed)


@query(_QA_SQL + """SELECT total, total - failed AS passed, failed, warnings, round((total - failed) / total, 4) AS pass_rate, price_failed, gaps, structural FROM (SELECT (SELECT count(*) FROM i) AS total, count(*) FILTER (level = 'error') AS failed, count(*) FILTER (level = 'warning') AS warnings,
  count(*) FILTER (issue = 'BASE_PRICE_MISMATCH') AS price_failed, count(*) FILTER (issue = 'CODE_GAP') AS gaps, count(*) FILTER (issue NOT IN ('BASE_PRICE_MISMATCH', 'CODE_GAP')) AS structural FROM q)""")
def qa_summary(spark, d):
    items, lines, listed = _items(spark, d)
    return quality.qa_summary(items, quality.qa_issues(items, lines, 20.0, listed))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '成都市信息价' || (2000 + doc_id % 27) || '-' || (doc_id % 12 + 1) WHEN 1 THEN (2000 + doc_id % 27) || '年成都市工程造价信息价第' || (doc_id % 12 + 1) || '期.pdf' WHEN 2 THEN '重庆工程造价' || (2000 + doc_id % 27) || '-' || (doc_id % 12 + 1) || '期6-17.pdf'
  WHEN 3 THEN (2000 + doc_id % 27) || '年' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '月北京市造价.pdf' WHEN 4 THEN '武汉市建设工程综合价格信息（' || (2000 + doc_id % 27) || '年' || (doc_id % 12 + 1) || '月）.pdf' ELSE doc_id || '.pdf' END AS name FROM documents)
SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1) THEN '成都' WHEN doc_id % 8 = 2 THEN '重庆' WHEN doc_id % 8 = 3 THEN '北京' WHEN doc_id % 8 = 4 THEN '武汉' WHEN doc_id % 8 = 5 THEN '湖北' WHEN doc_id % 8 = 6 THEN '广州' END AS city,
  CASE WHEN doc_id % 8 < 6 THEN 2000 + doc_id % 27 WHEN doc_id % 8 = 6 THEN 0 END AS year, CASE WHEN doc_id % 8 < 6 THEN CAST(doc_id % 12 + 1 AS VARCHAR) WHEN doc_id % 8 = 6 THEN '00' END AS period FROM f""")
def city_detection(spark, d):
    """File names, titles and regions of six publishers, made of document ids."""
    kind, year, month = F.col("doc_id") % 8, (F.col("doc_id") % 27 + 2000).cast("string"), (F.col("doc_id") % 12 + 1).cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.when(kind == 0, put("成都市信息价", year, "-", month)).when(kind == 1, put(year, "年成都市工程造价信息价第", month, "期.pdf")).when(kind == 2, put("重庆工程造价", year, "-", month, "期6-17.pdf"))
    name = name.when(kind == 3, put(year, "年", F.lpad(month, 2, "0"), "月北京市造价.pdf")).when(kind == 4, put("武汉市建设工程综合价格信息（", year, "年", month, "月）.pdf")).otherwise(put(F.col("doc_id").cast("string"), ".pdf"))
    title = F.when(kind == 5, put(year, "年第", month, "期《湖北工程造价管理》"))
    found = keys.detected_city(name, title, F.when(kind == 6, "440100").otherwise("110000"))
    return table(spark, d, "documents").select("doc_id", found.alias("c")).select("doc_id", "c.city", F.col("c.year").cast("long").alias("year"), "c.period")
