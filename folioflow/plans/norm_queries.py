"""Norm books made of the driver's orders, parsed again, with what must come out told by SQL from the same lines.

A customer is a book. An order is a table of two items whose resources are its lines, by return flag with one category cell
for each run; it goes on over pages of three lines. A customer's orders with a key divisible by four are printed as one
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from ..sources.tables import whole_tables
from .driver_queries import query
from .norm_tables import Form, parse
from .sections import sections

FORM = Form(code=r"[AB]\d{5,}", fees="missing", material_fee="missing")


def _row(*cells) -> F.Column:
    """A table row of (text, columns, rows) or of what is a cell already."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f'<td colspan="{c[1]}">'), c[0], F.lit("</td>")) if isinstance(c, tuple) else c for c in cells], F.lit("</tr>\n"))


def _books(spark, d) -> DataFrame:
    """(file, content) for each customer with orders that have lines."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("file"), "o_orderpriority")
    by_order = Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    lines = table(spark, d, "lineitem").withColumn("r", F.row_number().over(by_order)).join(orders, F.col("l_orderkey") == F.col("k"))
    lines = lines.withColumn("whole", F.col("k") % 4 == 0).withColumn("page", F.when(F.col("whole"), 0).otherwise(F.floor((F.col("r") - 1) / 3)))
    run = Window.partitionBy("k", "page", "l_returnflag")
    label = F.when(F.col("l_returnflag") == "A", "材料").when(F.col("l_returnflag") == "N", "机具").otherwise("附项")
    first = F.row_number().over(run.orderBy("r")) == 1
    category = F.when(first, F.concat(F.lit('<td rowspan="'), F.count("*").over(run).cast("string"), F.lit('">'), label, F.lit("</td>"))).otherwise("")
    other = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2)
    amount = F.col("l_quantity").cast("int").cast("string")
    second = F.round(F.col("l_tax") * 100).cast("int")
    cells = [
        category, (F.when(other, "其他材料费").otherwise(F.concat(F.lit("$\\phi$ "), text("l_partkey"))), 1), (F.when(other, "%").otherwise("$m^{3}$"), 1), (F.when(other, "-").otherwise(F.concat(text(F.col("l_suppkey") % 90 + 10), F.lit(".00"))), 1),
        (F.when(F.col("l_linenumber") == 5, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount), 1), (F.when(second == 0, "-").otherwise(second.cast("string")), 1),
    ]
    pages = lines.withColumn("tr", _row(*cells)).groupBy("file", "k", "whole", "page", "o_orderpriority").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tr"))), lambda x: x["tr"]), "").alias("body"))
    code = lambda c: F.concat(F.lit(c), text(F.col("k") + 10000))
    codes = _row((F.lit("定额编号"), 4), (code("A"), 1), (code("B"), 1))
    fee = lambda name, a, b: _row((F.lit(name), 4), (a, 1), (b, 1))
    overheads = F.when(F.col("k") % 2 == 0, fee("管理费(元)", text(F.col("k") % 9 + 1), F.lit("1"))).otherwise("")
    head = F.concat(
        codes, _row((F.lit("项目"), 4), (F.concat(F.lit("wall "), "o_orderpriority"), 1), (F.lit("$\\alpha$ b"), 1)), fee("综合基价(元)", text(F.col("file") % 1000 + 1), F.lit("")),
        fee("人工费(元)", text(F.col("k") % 50), F.lit("-")), fee("材料费(元)", text(F.col("k") % 30), F.lit("7")), fee("机械费(元)", text(F.col("k") % 20), F.lit("")), overheads, fee("利润(元)", F.lit("5.00"), F.lit("6")),
        _row((F.lit("名称"), 2), (F.lit("单位"), 1), (F.lit("单价"), 1), (F.lit("消耗量"), 2)),
    )
    pages = pages.withColumn("body", F.concat(F.when(F.col("page") == 0, head).otherwise(codes), "body"))
    prefix = F.when(F.col("page") == 0, F.concat(F.lit("工作内容：lay "), text("k"), F.lit("\n单位：$10 m^{3}$\n"))).otherwise("go on\n")
    alone = pages.where("NOT whole").select("file", "k", "page", F.concat(prefix, F.lit("<table>"), "body", F.lit("</table>\n")).alias("part"))
    merged = pages.where("whole").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "").alias("body"))
    merged = merged.select("file", F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("page"), F.concat(F.lit("工作内容：lay all 单位：t\n<table>"), "body", F.lit("</table>\n")).alias("part"))
    # Parsing costs much for few bytes, so books are dealt out by number and not by size.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return alone.unionByName(merged).repartition(n, "file").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "page", "part"))), lambda x: x["part"]), "").alias("content"))


@query(r"""
WITH l AS (
  SELECT o_custkey AS file, o_orderkey AS k, o_orderpriority, o_orderkey % 4 = 0 AS whole, l_returnflag AS flag, l_linenumber AS n, l_partkey, l_suppkey % 90 + 10 AS price, CAST(l_quantity AS INTEGER) AS a, CAST(round(l_tax * 100) AS INTEGER) AS b,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT *, CASE WHEN whole THEN 0 ELSE (r - 1) // 3 END AS page, flag = 'A' AND n = 2 AS other, n = 5 AS loose FROM l),
q AS (SELECT *, min(flag) OVER (PARTITION BY k, page) < 'R' AS goes_on, unnest([0, 1]) AS item FROM p),
v AS (
  SELECT *, CASE item WHEN 0 THEN a ELSE b END AS x,
    sum(CASE WHEN page = 0 AND flag = 'A' AND NOT other AND NOT loose THEN price * (CASE item WHEN 0 THEN a ELSE b END) ELSE 0 END) OVER (PARTITION BY k, item) AS basis
  FROM q WHERE page = 0 OR goes_on),
w AS (SELECT *, CASE WHEN loose THEN NULL WHEN other AND page = 0 THEN basis * x / 100.0 WHEN other THEN x ELSE price * x END AS y FROM v),
o AS (
  SELECT DISTINCT file, k, o_orderpriority, whole, item, bool_or(page = 0 AND flag <> 'N') OVER (PARTITION BY k) AS has_material, bool_or(page = 0 AND flag = 'N') OVER (PARTITION BY k) AS has_machine,
    sum(CASE WHEN page = 0 AND flag = 'R' THEN 0 ELSE coalesce(y, 0) END) OVER (PARTITION BY k, item) AS listed FROM w),
h AS (SELECT *, CASE item WHEN 0 THEN k % 50 ELSE 0 END AS labour, CASE item WHEN 0 THEN k % 9 + 1 ELSE 1 END AS overhead, CASE item WHEN 0 THEN 5 ELSE 6 END AS profit FROM o),
a AS (
  SELECT file, k, item, 0 AS slot, 0 AS page, 0 AS r, '定' AS kind, CASE item WHEN 0 THEN 'wall ' || o_orderpriority ELSE 'α b' END AS name, CASE WHEN whole THEN 't' ELSE '10m3' END AS unit, '' AS quantity,
    CASE item WHEN 0 THEN CAST(file % 1000 + 1 AS VARCHAR) ELSE '' END AS price, listed + labour + profit + CASE WHEN k % 2 = 0 THEN overhead ELSE 0 END AS verify FROM h
  UNION ALL SELECT file, k, item, 1, 0, 0, '工', '人工费', '元', CASE item WHEN 0 THEN CAST(labour AS VARCHAR) ELSE '' END, '1.00', labour FROM h
  UNION ALL SELECT file, k, item, 3, 0, 0, '料', '材料费', '元', CAST(CASE item WHEN 0 THEN k % 30 ELSE 7 END AS VARCHAR), '1.00', CASE item WHEN 0 THEN k % 30 ELSE 7 END FROM h WHERE NOT has_material AND CASE item WHEN 0 THEN k % 30 ELSE 7 END > 0
  UNION ALL SELECT file, k, item, 5, 0, 0, '机', '机械费', '元', CAST(k % 20 AS VARCHAR), '1.00', k % 20 FROM h WHERE NOT has_machine AND item = 0 AND k % 20 > 0
  UNION ALL SELECT file, k, item, CASE WHEN page = 0 THEN 4 WHEN k % 2 = 0 THEN 6 ELSE 8 END, page, r, CASE WHEN flag = 'N' THEN '机' WHEN loose THEN '配' ELSE '料' END, CASE WHEN other THEN '其他材料费' ELSE 'φ ' || l_partkey END,
    CASE WHEN other THEN '%' ELSE 'm3' END, CASE WHEN item = 1 AND x = 0 THEN '' ELSE CAST(x AS VARCHAR) END, CASE WHEN other THEN '' ELSE price || '.00' END, y FROM w
  UNION ALL SELECT file, k, item, 7, 0, 0, '综', '企业管理费', '元', '100.00', CAST(overhead AS VARCHAR), overhead FROM h WHERE k % 2 = 0
  UNION ALL SELECT file, k, item, 7, 0, 1, '综', '利润', '元', '100.00', CASE item WHEN 0 THEN '5.00' ELSE '6' END, profit FROM h)
SELECT CAST(file AS VARCHAR) AS file, CASE item WHEN 0 THEN 'A' ELSE 'B' END || (k + 10000) AS code, row_number() OVER (PARTITION BY k, item ORDER BY slot, page, r) AS line, kind, name, unit, quantity, price, CAST(round(verify, 2) AS DOUBLE) AS verify FROM a
""")
def norm_lines(spark, d):
    parsed = parse(whole_tables(_books(spark, d), "file", "content"), FORM)
    item = Window.partitionBy("file", "table_no", "part", "item").orderBy("slot", "place")
    out = parsed.lines.select("file", F.first("code").over(item).alias("code"), F.row_number().over(item).cast("long").alias("line"), "kind", "name", "unit", "quantity", "price", "verify")
    return out.withColumn("verify", F.col("verify").try_cast("double"))


@query(r"""
WITH RECURSIVE d AS (SELECT source AS file, doc_id // 400 AS table_no, doc_id AS doc, (doc_id * 7919 + doc_id // 13) % 10 AS kind, doc_id % 12 + 1 AS n, ['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二'][doc_id % 12 + 1] AS cn FROM documents),
w AS (
  SELECT *, lead(kind) OVER t AS next, lag(kind) OVER t AS prev, lag(doc) OVER t AS prev_at, max(CASE WHEN kind = 0 THEN doc END) OVER (PARTITION BY file, table_no) = doc AS last_chapter,
    bool_or(kind IN (7, 8)) OVER (PARTITION BY file, table_no ORDER BY doc ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS near, row_number() OVER (PARTITION BY file ORDER BY table_no, doc) AS i
  FROM d WINDOW t AS (PARTITION BY file, table_no ORDER BY doc)),
e AS (
  SELECT *, CASE WHEN kind = 0 THEN CASE WHEN last_chapter THEN 'chapter' END WHEN kind < 3 THEN CASE WHEN near THEN 'section' END WHEN kind < 5 THEN CASE WHEN next BETWEEN 3 AND 8 THEN 'subsection' END
    WHEN next NOT IN (7, 8) OR next IS NULL THEN NULL WHEN kind = 9 THEN 'title' WHEN kind < 7 THEN CASE WHEN prev = 9 THEN 'under title' ELSE 'paragraph' END END AS ev FROM w),
r AS (
  SELECT DISTINCT file, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS s, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS BIGINT) AS c0, CAST(NULL AS BIGINT) AS s0, CAST(NULL AS VARCHAR) AS b0 FROM d
  UNION ALL
  SELECT e.file, e.i, CASE WHEN ev = 'chapter' OR (ev = 'section' AND c IS NULL) THEN n ELSE c END, CASE WHEN ev = 'chapter' THEN NULL WHEN ev = 'section' AND c IS NOT NULL THEN n ELSE s END,
    CASE WHEN ev IN ('chapter', 'section') THEN NULL WHEN s IS NULL THEN b WHEN ev = 'subsection' THEN CAST(n AS VARCHAR) WHEN ev = 'title' OR (ev = 'under title' AND b IS NULL) THEN 'X' ELSE b END, c, s, b
  FROM r JOIN e ON e.file = r.file AND e.i = r.i + 1),
x AS (
  SELECT e.*, unnest(CASE
    WHEN ev = 'chapter' THEN [(0, 'A.' || n, '墙' || doc)] WHEN ev = 'section' AND c0 IS NULL THEN [(0, 'A.' || n, cn || '、节' || doc)] WHEN ev = 'section' THEN [(0, 'A.' || c0 || '.' || n, cn || '、节' || doc)]
    WHEN s0 IS NULL THEN [] WHEN ev = 'subsection' THEN [(0, concat_ws('.', 'A', c0, s0, n), n || '. 目' || doc)] WHEN ev = 'title' THEN [(0, concat_ws('.', 'A', c0, s0, 'X'), '名' || doc)]
    WHEN ev IN ('paragraph', 'under title') AND b0 IS NOT NULL THEN [(0, concat_ws('.', 'A', c0, s0, b0, CASE WHEN b0 = 'X' OR kind = 6 THEN 'X' ELSE CAST(n AS VARCHAR) END), CASE kind WHEN 5 THEN '(' || n || ') 段' ELSE '() 段' END || doc)]
    WHEN ev = 'under title' THEN [(0, concat_ws('.', 'A', c0, s0, 'X'), '名' || prev_at), (1, concat_ws('.', 'A', c0, s0, 'X', 'X'), CASE kind WHEN 5 THEN '(' || n || ') 段' ELSE '() 段' END || doc)] ELSE [] END) AS made
  FROM e JOIN r USING (file, i))
SELECT file, table_no, made[1] AS place, made[2] AS code, made[3] AS name FROM x
""")
def section_paths(spark, d):
    """Documents as lines of the book of their source, four hundred ids between two tables."""
    n, at = F.col("doc_id") % 12 + 1, F.col("doc_id").cast("string")
    numeral = F.get(F.array(*[F.lit(c) for c in ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")]), (n - 1).cast("int"))
    kind, word = (F.col("doc_id") * 7919 + F.floor(F.col("doc_id") / 13)) % 10, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], at)
    number = n.cast("string")
    line = F.when(kind == 0, word("## 第", numeral, "章 墙")).when(kind < 3, word(numeral, "、节")).when(kind < 5, word(number, ". 目")).when(kind == 5, word("(", number, ") 段"))
    line = line.when(kind == 6, word("() 段")).when(kind < 9, word("工作内容：")).otherwise(word("名"))
    rows = table(spark, d, "documents").select(F.col("source").alias("file"), F.floor(F.col("doc_id") / 400).alias("table_no"), "doc_id", line.alias("line"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"])
    prefixes = rows.groupBy("file", "table_no").agg(F.array_join(texts, "\n\n").alias("prefix")).withColumn("volume", F.lit("A"))
    return sections(prefixes, "chinese").select("file", "table_no", F.col("place").cast("int").alias("place"), "code", "name")
