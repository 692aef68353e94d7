"""Literal cases of the catalogue's rules."""

import io
import zipfile

from pyspark.sql import functions as F

from folioflow.functions import keys, periods, text
from folioflow.operators import graph, joins, sequences
from folioflow.plans import archives, audit, cleanup, comparison, coverage, ingest, manifest, notes, quality
from folioflow.sources import dimensions, files, registry, tables
from folioflow.streaming import feeds


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr).first()[0]


def test_scalars(spark):
    c = F.col("x")
    assert one(spark, keys.cost_info_key(F.lit("source-1"), F.lit("650000"), F.lit("2026-06"), c), x=" ２０２６年６月　建設工程綜合價格信息（烏魯木齊） ") == "cost_info:source-1:650000:2026-06:2026年6月 建设工程综合价格信息 乌鲁木齐"
    url = "HTTPS://Example.Gov.CN/price/list?utm_source=wechat&page=2&b=2&a=1&spm=abc#section"
    for f in (text.url_key, text.url_key_plain):
        assert one(spark, f(c), x=url) == "https://example.gov.cn/price/list?a=1&b=2&page=2"
    assert one(spark, keys.trading_key(F.lit("src"), c, F.lit("t"), F.lit("d"), F.lit("k")), x="notice-001") == "trading:src:notice-001"
    assert one(spark, periods.month_of(c), x="2025年12月北京工程造价信息") == "2025-12" and one(spark, periods.month_of(c), x="2026年4月") == "2026-04"
    assert [one(spark, text.first_number(c), x=v) for v in ("115", "208.98", "1,234.56", "—", "")] == [115.0, 208.98, 1234.56, None, None]
    assert one(spark, text.number_or_zero(c), x="(10.500)") == 10.5 and one(spark, text.plain_number(c.cast("double")), x="2.5") == "2.5"
    assert one(spark, text.tax_rate(c, F.lit("100")), x="113") == "13.0%" and one(spark, text.tax_rate(c, F.lit("0")), x="113") == ""
    assert one(spark, periods.issue_of(c), x="第十二期") == 12 and one(spark, text.similarity(c, F.lit("混合工")), x="混合工") == 1.0
    assert one(spark, keys.file_role(c, F.lit("")), x="清单.cjz") == "priced_source"
    assert one(spark, F.array_join(periods.months_between(F.lit("2025-11"), c), ","), x="2026-01") == "2025-11,2025-12,2026-01"
    assert str(one(spark, periods.next_slot(c.cast("timestamp"), [1, 15], ["09:00:00"]), x="2026-01-15 02:00:00")) == "2026-02-01 01:00:00"


def test_grids(spark):
    assert tables.grid("<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>") == [["A", "B"], ["A", "C"]]
    assert tables.grid("<table><tr><td colspan=2>A</td><td>B</td></tr><tr><td>C<td>D<td>E</tr></table>") == [["A", "A", "B"], ["C", "D", "E"]]
    assert tables.grid("<table><tr><td rowspan=2 colspan=2>A</td><td>B</td></tr><tr><td>C</td></tr><tr><td>D</td><td>E</td><td>F</td></tr></table>") == [["A", "A", "B"], ["A", "A", "C"], ["D", "E", "F"]]
    assert tables.grid("") == []
    page = "<table><tr><td colspan=4>定额编号</td><td>AA0001</td><td>AA0002</td></tr><tr><td>人工</td><td>混合工</td><td>工日</td><td>115</td><td>1.817</td><td>2</td></tr></table>"
    out = tables.quota_items(tables.table_cells(spark.createDataFrame([("p", page)], "k string, h string"), "k", "h")).orderBy("code").collect()
    assert [(r.code, r.name, r.unit, r.price, r.quantity) for r in out] == [("AA0001", "混合工", "工日", 115.0, 1.817), ("AA0002", "混合工", "工日", 115.0, 2.0)]


def test_quality(spark):
    items = spark.createDataFrame([("a", 208.98), ("b", 300.0), ("c", 100.05)], "code string, base_price double")
    lines = spark.createDataFrame([("a", 1.817, 115.0), ("b", 1.817, 115.0), ("c", 1.0, 100.0)], "code string, quantity double, price double")
    assert {r.code: r.issue for r in quality.price_check(items, lines).collect()} == {"a": "ok", "b": "BASE_PRICE_MISMATCH", "c": "ok"}
    codes = spark.createDataFrame([("AA0001",), ("AA0003",), ("BB0001",), ("x1",)], "code string")
    assert [r.missing for r in sequences.sequence_gaps(codes, "code").collect()] == ["AA0002"]
    issues = manifest.storage_audit(spark.createDataFrame([("x", 4), ("y", 6), ("z", 8)], "key string, expected long"), spark.createDataFrame([("x", 4), ("z", 3)], "key string, actual long"))
    assert tuple(manifest.audit_totals(issues).first()) == (3, 1, 1, 1, 18, 7)


def test_components_and_ingest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (5, "c"), (4, None)], "n int, e string")
    assert {r.node: r.component for r in graph.components(rows, "n", "e").collect()} == {1: 1, 2: 1, 3: 1, 5: 5}
    found = spark.createDataFrame([("k3", 1), ("k2", 2), ("k1", 3)], "key string, at int")
    known = spark.createDataFrame([("k2",)], "key string")
    out = ingest.crawled(found.withColumn("g", F.lit(1)), known, "key", ["g"], [F.col("at")]).orderBy("at").collect()
    assert [(r.key, r.is_new) for r in out] == [("k3", True), ("k2", False)]
    steps = spark.createDataFrame([("b", 1, "draft"), ("b", 2, "ingested"), ("b", 3, "usable")], "book_id string, seq int, state string")
    assert [r.seq for r in ingest.bad_transitions(steps).collect()] == [3]


def test_files(spark, tmp_path):
    rows = [["banner"], ["序号", "材料名称及规格型号", "单位", "除税综合\n信息价", "含税综合\n信息价"], [1, "盘条", "t", 3200.99, 3609.12], [2, "螺纹钢", "t", 4000, 452], [None, "备注 x"]]
    (tmp_path / "a.xlsx").write_bytes(files.write_xlsx({"价格": rows}))
    found = files.read_xlsx(spark.read.format("binaryFile").load(str(tmp_path / "a.xlsx")))
    sheet = files.price_sheet(found).orderBy("row_no").collect()
    assert [(r.name, r.unit, r.price, r.price_with_tax) for r in sheet] == [("盘条", "t", "3200.99", "3609.12"), ("螺纹钢", "t", "4000", "452")]
    risks = quality.price_risks(files.price_sheet(found)).collect()
    assert {(r.row_no, r.risk) for r in risks} == {(4, "tax_below_net"), (4, "steel_too_cheap")}
    (tmp_path / "b.csv").write_bytes("﻿a,b\n1,x\n2,y\n".encode())
    assert [(r.a, r._line_number) for r in files.read_csv(spark, str(tmp_path / "b.csv"), ["a", "b"]).orderBy("_line_number").collect()] == [("1", 2), ("2", 3)]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/x.txt", "hi")
        f.writestr("__MACOSX/x", "no")
    (tmp_path / "c.zip").write_bytes(z.getvalue())
    assert [(r.member, r.size) for r in files.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "c.zip"))).collect()] == [("in/x.txt", 2)]
    site = registry.Site("s", "https://h.example/list/", wanted="信息")
    assert list(registry.parse_list(site, 1, '<a href="/x.pdf">2026年5月 造价信息</a><a href="y">other</a>')) == [("s", 1, "https://h.example/x.pdf", "2026年5月 造价信息", "2026-05", "s:2026-05")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id < 60").write.parquet(src)
    schema = events.schema
    run = lambda: feeds.poll(feeds.event_stream(spark, src, schema), feeds.ingest_new(str(tmp_path / "out"), "event_id"), str(tmp_path / "cp"))
    run()
    events.where("event_id BETWEEN 40 AND 79").write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("event_id").distinct().count() == events.where("event_id < 80").count()
    q = feeds.tumbling(feeds.event_stream(spark, src, schema)).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()
    assert feeds.outbox(spark.read.parquet(src)).count() == got.count()


def many(spark, expr, values):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n in "xyz"[: len(values[0]) if isinstance(values[0], tuple) else 1]))
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_roles_and_keys(spark):
    files_ = {
        ("清单.cjz", None, ""): "priced_source", ("招标文件.CDZ", "trading", ""): "zip_package", ("招标文件.CDZ", "trading", "qingdan_package"): "qingdan_package",
        ("东升项目施工图.zip", "trading", "工程图"): "drawing", ("地勘报告.pdf", "trading", ""): "geological", ("招标文件正文.pdf", "trading", ""): "tender_doc",
        ("四川2020定额库.xlsx", "quota", ""): "quota_db", ("GB50500-2013清单计价规范.pdf", "quota", ""): "bill_standard", ("补充定额.pdf", "quota", ""): "quota_supplement", ("普通附件.xlsx", "quota", ""): "attachment",
        ("费率表附件.xlsx", "policy_regulation", ""): "policy_attachment", ("构造大样扫描图.png", "standard_atlas", ""): "scan_image", ("23J909工程做法.pdf", "standard_atlas", ""): "atlas_document",
    }
    assert many(spark, keys.file_role(F.col("x"), F.col("y"), F.col("z")), list(files_)) == list(files_.values())
    n = F.lit(None).cast("string")
    assert one(spark, keys.quota_key(F.lit("s"), n, F.lit("sichuan"), c := F.col("x"), F.lit("2020"), F.lit("2020-01-01"), n), x="JZZS") == "quota:sichuan:JZZS:2020:2020-01-01"
    assert one(spark, keys.quota_key(F.lit("s"), n, F.lit("sichuan"), n, F.lit("2013"), n, c), x="DB51/T50500") == "quota:sichuan:DB51/T50500:2013"
    assert one(spark, keys.policy_key(n, n, c, n), x="〔2026〕12号") == "policy:〔2026〕12号" and one(spark, keys.atlas_key(n, n, c, F.lit("2012")), x="GB50345") == "standard_atlas:GB50345:2012"
    assert many(spark, text.unit(F.col("x")), ["10m³", "5m²", r"$\mathbf{m}^3$", "m<sup>2</sup>", "公斤"]) == ["10m3", "5m2", "m3", "m2", "公斤"]
    assert many(spark, text.markup_unit(F.col("x")), [r"$ 100 \mathrm{m}^{3} $", "$m^2$", "—", "k", "t", None]) == ["100m3", "m2", "", "kg", "t", ""]
    assert many(spark, text.resource_text(F.col("x")), ["公斤", "Ｍ１０　砂浆", "工"]) == ["kg", "M10 砂浆", "工日"]
    assert many(spark, periods.token_period(F.col("x")), ["2026-2", "26.3", "2026年3月", "26年第3期", "202603", "2026/13", "x", "263"]) == ["2026-02", "2026-03", "2026-03", "2026-03", "2026-03", None, None, "2026-03"]
    assert many(spark, periods.title_period(F.col("x")), ["成都市2026年第5期信息价.pdf", "2026年06月", "x", None]) == [(2026, 5), (2026, 6), None, None]
    assert many(spark, periods.edition_year(n, F.col("x"), F.col("y"), F.col("z")), [("1999", "", ""), ("", "书（2024）", ""), (None, None, "2018"), (None, "", "")]) == ["1999", "2024", "2018", None]
    assert many(spark, keys.publisher(F.col("x"), F.col("y")), [("造价协会", "city"), ("government", "province"), ("shop", "city")]) == ["association:city", "station:province", None]


def test_gap_rules(spark):
    flags = "id int, covered boolean, blocked boolean, has_source boolean, later boolean, earlier boolean, task_status string, error_code string"
    rows = [(1, True, False, True, False, False, "failed", "PARSE_ERROR"), (2, False, True, True, True, False, None, None), (3, False, None, None, False, False, "pending", None), (4, False, False, True, True, False, None, None), (5, False, False, True, False, True, "failed", "DOWNLOAD_TIMEOUT"), (6, False, False, True, False, False, "running", None)]
    got = lambda compat: [tuple(r) for r in coverage.classified(spark.createDataFrame(rows, flags), compat).orderBy("id").select("gap_type", "gap_reason", "failed_stage", "cell_status", "actionable").collect()]
    want = [("covered", None, None, "in_lake", False), ("pending_verify", "no_source", None, "missing", False), ("missing", "no_source", None, "queued", False), ("pending_verify", "not_published", None, "missing", False), ("pending_verify", "failed", "download_timeout", "failed", True), ("missing", "not_attempted", None, "crawling", True)]
    assert got(False) == want
    want[0], want[2] = ("covered", None, "parse_error", "in_lake", False), ("pending_verify", "no_source", None, "queued", False)
    assert got(True) == want
    assert many(spark, coverage.target_level(F.col("x"), F.col("y")), [("Province", "110000"), ("province", "510000"), ("county", ""), ("prefecture", ""), ("", "")]) == ["city", "province", "subregion", "city", None]


def test_notes(spark):
    import re

    body = "说明 本章适用于一般土建工程。\n1. 挖土方按体积计算\n2、短\n注：人工乘以系数1.25，材料增加 3.5 。调整.."
    rows = spark.createDataFrame([("p", body), ("q", "abc"), ("r", "  "), ("s", None)], "k string, t string")
    assert [(r.k, r.note_no, r.kind, r.text) for r in notes.notes(rows, "k", "t").orderBy("k", "note_no").collect()] == [("p", 0, "scope", "本章适用于一般土建工程。"), ("p", 1, "calc_rule", "挖土方按体积计算"), ("p", 2, "calc_rule", "人工乘以系数1.25，材料增加 3.5 。调整.."), ("q", 0, "other", "abc")]
    long = "前" * 70 + body + "后" * 70
    want = []
    for m in re.finditer(notes.COEFFICIENT, long):
        try:
            want.append((m[0], float(m[1]), long[max(0, m.start() - 50) : m.end() + 50].strip()))
        except ValueError:
            pass
    got = notes.coefficients(spark.createDataFrame([("p", long), ("n", None)], "k string, t string"), "k", "t").orderBy("hit_no").collect()
    assert [(r.keyword, r.value, r.source_text) for r in got] == want and len(want) == 2
    blocks = [(1, "table", None, "<td>综合基价</td>"), (2, "table", None, "附录"), (3, "text", "目录", None), (4, "text", "A.1 土石方", None), (5, "text", "计算规则", None), (6, "table", "x", "y"), (7, "text", "", None)]
    kinds = notes.page_kinds(spark.createDataFrame(blocks, "page int, type string, text string, html string")).orderBy("page").collect()
    assert [r.kind for r in kinds] == ["quota_table", "appendix_price", "cover_toc", "chapter_title", "notes", "quota_table", "other"]


def test_audit(spark):
    names = "province_code province_name target_region_code target_region_name source_status review_status site_id source_name adapter_kind crawl_pattern entry_url evidence_url blocked_reason audit_note manual_path".split()
    row = lambda n, **c: (n, *[c.get(x, "") for x in names])
    rows = spark.createDataFrame([row(2, target_region_code="110000", source_status="auto_crawl_ready", review_status="accepted"), row(3, target_region_code="510100", source_status="source_blocked", blocked_reason="x", manual_path="017/manual_upload")], "_line_number int, " + ", ".join(f"{n} string" for n in names))
    regions = spark.createDataFrame([(c, True) for c in ("110000", "510100", "510300")] + [("1", False)], "target_region_code string, is_required boolean")
    assert [(r[0], len(r.errors)) for r in audit.row_errors(rows, regions).collect()] == [(2, 3)]
    assert sorted(r[0] for r in audit.unaudited(rows, regions).collect()) == ["510100", "510300"]
    assert tuple(audit.summary(rows, regions).first()) == (3, 1, 2, 1, False)
    assert audit.crawl_queue(rows).count() == 1 and audit.blocked(rows).first().blocked_reason == "x" and audit.pattern_counts(rows).first().source_count == 1
    runs = spark.createDataFrame([("a", 0, 0, 0, None), ("b", 0, 0, 1, 0), ("c", 1, 0, 0, 0)], "run_id string, file_rows int, dead_letters int, retries int, failed int")
    assert [r.health for r in audit.health(runs).orderBy("run_id").collect()] == ["healthy", "degraded", "critical"]


def test_comparison(spark):
    rows = [("A", 1, "段", "", "一"), ("A", 2, "定", "X1", "挖土方"), ("A", 3, "工", "", "人工"), ("A", 4, "定", "X2", "填方"), ("A", 5, "定", "X1", "挖土方"), ("A", 6, "段", "", "一.1"), ("A", 7, "定", "X3", "挖沟槽"), ("A", 8, "料", "", "水"), ("A", 9, "段", "", "二"), ("A", 10, "注", "", "x"), ("B", 1, "定", "X1", None)]
    frame = spark.createDataFrame(rows, "province string, row_no long, kind string, code string, name string")
    hits = comparison.item_hits(frame, F.contains("name", F.lit("挖")), F.when(F.col("name").contains("."), 2).otherwise(1), 2).orderBy("row_no")
    assert [(r.row_no, r.section_1, r.section_2, r.new_section) for r in hits.collect()] == [(2, "一", None, True), (3, "一", None, False), (7, "一", "一.1", True), (8, "一", "一.1", False)]
    assert [tuple(r) for r in comparison.province_counts(hits).collect()] == [("A", 2)]
    assert [r.cells for r in comparison.sheet_rows(hits, ["code", "name"], 2).collect()] == [["A"], ["一"], ["X1", "挖土方"], ["", "人工"], ["一"], ["一.1"], ["X3", "挖沟槽"], ["", "水"]]


def test_cleanup(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "node string, component string")
    archives = spark.createDataFrame([(x, m, False, 1) for x, m in (("a", False), ("b", True), ("c", True), ("d", False), ("e", False))], "archive_id string, has_mount boolean, is_rebuilt boolean, status_score int").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    orphans = spark.createDataFrame([("a", 1), ("c", 2), ("d", 1), ("e", 1), ("e", 0)], "archive_id string, candidates int")
    got = {r.archive_id: (r.action, r.canonical_id) for r in cleanup.actions(members, archives, orphans).collect()}
    assert got == {"a": ("withdraw_duplicate", "b"), "c": ("remove_redundant_orphan_reference", None), "d": ("relink_orphan", None), "e": ("manual_review", None)}


def matrix(spark, sources, archives, first, last, files=()):
    """The matrix of sources given as dicts, with targets as dicts, and archives (id, title, region, period, source, label)."""
    fields = [f.split(" ") for f in coverage.TARGET.split(", ")]
    target = "struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">"
    names = "source_id seq name region_code province city scope publisher_region_code coverage_region_code remark targets entry_url official_url public_url url base_url".split()
    schema = ", ".join(f"{n} {'int' if n == 'seq' else f'array<{target}>' if n == 'targets' else 'string'}" for n in names)
    rows = [tuple([tuple(t.get(n) for n, _ in fields) for t in s[n]] if n == "targets" and n in s else i if n == "seq" else s.get(n) for n in names) for i, s in enumerate(sources)]
    held = spark.createDataFrame([(*a[:5], None, a[5]) for a in archives], "archive_id string, title string, region_code string, period string, source_id string, publisher_scope string, issue_label string")
    mounted = spark.createDataFrame(list(files), "archive_id string, file_id string, file_name string, is_primary boolean, representation_role string, sort_order int, added_at int")
    return {(r.coverage_region_code, r.period): r for r in coverage.matrix(spark.createDataFrame(rows, schema), held, mounted, first, last).collect()}


def test_coverage_matrix(spark):
    city = {"source_id": "city", "name": "C", "region_code": "510700", "city": "绵阳市", "scope": "city", "publisher_region_code": "510700", "coverage_region_code": "510700-市区", "entry_url": "https://c"}
    said = lambda code, name: {"region_code": code, "region_name": name, "requires_city_source": True, "declared_periods": ["2026-04"], "coverage_note": "said"}
    province = {"source_id": "prov", "name": "P", "region_code": "510000", "scope": "province", "publisher_region_code": "510000", "entry_url": "http://p", "targets": [said("510700-市区", "绵阳市区"), said("510725", "梓潼县")]}
    got = matrix(spark, [city, province], [("a", "t", "510700-市区", "2026-04", "city", None)], "2026-04", "2026-04", [("a", "f2", "n2", False, "primary", 1, 1), ("a", "f1", "n1", True, "x", 9, 1)])
    a, b = got["510700-市区", "2026-04"], got["510725", "2026-04"]
    assert (a.business_coverage_status, a.coverage_region_name, a.source_completeness_status, a.province_source_count, a.city_source_count, a.source_visit_url, a.source_ids) == ("covered", "绵阳市区", "dual_source", 1, 1, "https://c", ["prov", "city"])
    assert (a.primary_file_id, a.primary_download_url, a.file_count, a.evidence_archive_ids) == ("f1", "/api/file-assets/f1/download", 2, ["a"])
    assert (b.business_coverage_status, b.source_completeness_status, b.province_source_count, b.city_source_count, b.source_visit_url, b.primary_file_id) == ("covered", "city_source_missing", 1, 0, "http://p", None)
    one = lambda code, **t: {"source_id": "s", "name": "S", "region_code": code, "scope": "city", "targets": [{"region_code": code, **t}]}
    got = matrix(spark, [one("650100")], [("a", "三明2026年第5期", "650100", "2026-04", "s", "第5期")], "2026-03", "2026-05")
    assert [got["650100", p].business_coverage_status for p in ("2026-03", "2026-04", "2026-05")] == ["pending_verify", "covered", "pending_verify"]
    assert "待回填核验" in got["650100", "2026-03"].coverage_note and "未发布" in got["650100", "2026-05"].coverage_note and got["650100", "2026-04"].coverage_note is None
    assert got["650100", "2026-04"].period_label == "第5期" and got["650100", "2026-04"].evidence_titles == ["三明2026年第5期"]
    got = matrix(spark, [one("350500", target_level="prefecture"), one("110000", target_level="province"), one("220000", source_completeness_status="source_blocked")], [], "2026-05", "2026-05")
    assert got["350500", "2026-05"].target_level == got["110000", "2026-05"].target_level == "city" and got["350500", "2026-05"].business_coverage_status == "missing"
    assert (got["220000", "2026-05"].business_coverage_status, got["220000", "2026-05"].source_completeness_status, got["220000", "2026-05"].source_ids) == ("pending_verify", "source_blocked", [])
    part = matrix(spark, [one("510100")], [("a", "t", "510100-xx", "2026-05", "s", None)], "2026-05", "2026-05")
    assert part["510100", "2026-05"].evidence_archive_ids == ["a"]


def test_published_rules(spark, tmp_path):
    sheets = {"A": [["序号", "材料名称", "单位", "不含税价", "含税价"], [1, "钢", "t", 3200, 3616], [2, "注：x", "t", 1, 1], [3, "空", "", "", ""]], "B": [["材料名称", "单位", "含税价", "除税价", "规格"], ["砂", "m3", 116, 100, "细"]], "C": [["名称", "单位", "含税价"], ["x", "t", 1]]}
    (tmp_path / "p.xlsx").write_bytes(files.write_xlsx(sheets))
    found = files.price_sheet(files.read_xlsx(spark.read.format("binaryFile").load(str(tmp_path / "p.xlsx")))).collect()
    assert sorted((r.name, r.spec, r.price, r.price_with_tax) for r in found) == [("砂", "细", "100", "116"), ("钢", "", "3200", "3616")]
    c = F.col("x")
    assert [one(spark, text.url_key(c), x=u) for u in ("http://[bad/x", "e.cn/p?b=%E4%B8%AD+a&a", "http://H/p?x=%zz&utm_X=1", "  HTTPS://h/#f ")] == ["http://[bad/x", "https:///e.cn/p?a=&b=%E4%B8%AD+a", "http://h/p?x=%25zz", "https://h/"]
    resources = spark.createDataFrame([(1, "材", "普通硅酸盐水泥", "公斤"), (2, "材", "xyz", "t"), (3, "机", "q", "t"), (4, "材", "普通硅酸盐水泥", "m3"), (5, "材", None, None)], "id int, category string, name string, unit string")
    candidates = spark.createDataFrame([("c1", "材", "普通硅酸盐水泥", "kg"), ("c2", "材", "水泥", "吨")], "candidate_id string, category string, name string, unit string")
    got = {r.id: (r.candidate_id, round(r.score, 4), r.matched) for r in joins.aligned(resources, candidates).collect()}
    assert got == {1: ("c1", 1.0, True), 2: ("c2", 0.2, False), 3: (None, 0.0, False), 4: ("c1", 0.9, False), 5: ("c1", 0.1, False)}
    items = spark.createDataFrame([("AA0001", "n", "m3", 10.0), ("AA0004", None, "", 5.0), ("AA0005", "n", "m3", None)], "code string, name string, unit string, base_price double")
    lines = spark.createDataFrame([("AA0001", "砂", 2.0, None), ("AA0001", "水", None, 3.0)], "code string, name string, quantity double, price double")
    appendix = spark.createDataFrame([("砂", 5.0)], "name string, price double")
    issues = quality.qa_issues(items, lines, appendix=appendix)
    assert sorted((r.code, r.issue) for r in issues.collect()) == [("AA0002", "CODE_GAP"), ("AA0003", "CODE_GAP"), ("AA0004", "BASE_PRICE_MISMATCH"), ("AA0004", "EMPTY_RESOURCES"), ("AA0004", "MISSING_NAME"), ("AA0004", "MISSING_UNIT")]
    assert tuple(quality.qa_summary(items, issues).first()) == (3, 1, 2, 4, 0.3333, 1, 2, 3)
    wide = spark.createDataFrame([("A1",), ("A9999999999999",), ("A" + "9" * 30,)], "code string")
    assert [tuple(r) for r in sequences.gap_ranges(wide, "code").collect()] == [("A", 1, 9999999999999)]
    assert sequences.sequence_gaps(spark.createDataFrame([("A1",), ("A250002",)], "code string"), "code").agg(F.count("*"), F.min("missing"), F.max("missing")).first()[:] == (250000, "A0002", "A99999")
    ids = graph.numbered(spark.range(1000).repartition(7), F.desc("id")).collect()
    assert sorted((r.number, r.id) for r in ids) == [(i + 1, 999 - i) for i in range(1000)]
    groups = graph.duplicate_groups(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("f", "f")], "node string, component string"), spark.createDataFrame([(x, x == "b", False, 1) for x in "abcdef"], "archive_id string, is_valid boolean, is_rebuilt boolean, status_score int").withColumn("created_at", F.lit("2026-01-01").cast("timestamp")))
    assert sorted((r.group_id, r.canonical, r.members) for r in groups.collect()) == [("DUP-0001", "e", ["c", "d", "e"]), ("DUP-0002", "b", ["a", "b"])]


def test_more_scalars(spark):
    c = F.col("x")
    assert many(spark, text.without_watermark(c), ["四川 省住房", "四川 混凝土", "", None]) == ["", "四川混凝土", "", ""]
    assert many(spark, keys.province_short(c), ["sc", "重庆", " 川建 "]) == ["sc", "cq", "sc"]
    import hashlib
    import json

    payload = json.dumps({"detail_url": 'http://x/"1"', "attachment_urls": ["a", "b"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert one(spark, text.attachment_fingerprint(c, F.array(F.lit("b"), F.lit("a"))), x='http://x/"1"') == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
    assert tuple(one(spark, periods.issue_period(c, r"(20\d{2})年第([\d—]+)期"), x="造价 2026年第5—6期")) == ("2026年第5—6期", 2026, 5, 6)
    assert tuple(one(spark, periods.bimonthly_period(c, r"(20\d{2})年(\d+)[-—](\d+)月"), x="2026年3—4月")) == ("2026年3-4月", "2026-03", 2026) and one(spark, periods.bimonthly_period(c, r"(20\d{2})年(\d+)-(\d+)月"), x="x") is None
    path = archives.mirror_path(F.lit("信息价"), F.lit("四川省"), F.lit("a/b"), F.lit("2026"), F.lit(" t.. "), c, F.lit("f?.pdf"))
    assert many(spark, path, ["original", "attachment"]) == ["信息价/四川省/a_b/2026/f_.pdf", "信息价/四川省/a_b/2026/t_/attachment-f_.pdf"]
    assert archives.markdown(spark.createDataFrame([(1, "a|b")], "n int, t string")) == "| n | t |\n|-|-|\n| 1 | a\\|b |"


def test_dimensions(spark, tmp_path):
    import json

    import pytest

    head = "admin_division_version,province_code,province_name,target_region_code,target_region_name,target_level,is_required,source_note\n"
    good = "v1,510000,四川,510100,成都,prefecture,是,\nv1,510000,四川,510131,蒲江,county,1,x\nv1,510000,四川,510131,蒲江,county,no,\n"
    (tmp_path / "r.csv").write_text("\ufeff" + head + good, encoding="utf-8")
    regions = dimensions.national_regions(spark, str(tmp_path / "r.csv"))
    assert [(r.province_code, r.required_targets, r.levels) for r in dimensions.region_levels(regions).collect()] == [("510000", 2, {"county": 1, "prefecture": 1})]
    assert dimensions.repeated_targets(regions).count() == 0
    for line, error in (("v1,510000,四川,510100,成都,planet,1,\n", "INVALID_TARGET_LEVEL line=2"), ("v1,,四川,510100,,county,1,\n", "NATIONAL_REGION_REQUIRED_FIELD_MISSING line=2: province_code,target_region_name")):
        (tmp_path / "bad.csv").write_text(head + line, encoding="utf-8")
        with pytest.raises(Exception, match=error):
            dimensions.national_regions(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "m.csv").write_text("target_region_code,province_name,target_region_name\n 1 ,P,R\n1,P2,\n2,,\n", encoding="utf-8")
    assert [tuple(r) for r in dimensions.region_map(spark, str(tmp_path / "m.csv")).collect()] == [("1", "P2", "")]
    (tmp_path / "x.json").write_text(json.dumps({"schema": "s", "rows": [{"name": "砂", "unit": "t"}, {"name": "水"}]}), encoding="utf-8")
    assert [(r.row_no, r.name, r.unit) for r in dimensions.payload_rows(spark, str(tmp_path / "x.json"), ["name", "unit"]).orderBy("row_no").collect()] == [(0, "砂", "t"), (1, "水", "")]
    sha = "ab" + "cd" + "0" * 60
    (tmp_path / "store/objects/ab/cd").mkdir(parents=True)
    (tmp_path / f"store/objects/ab/cd/{sha}.PDF").write_bytes(b"12345")
    (tmp_path / "store/objects/odd.txt").write_bytes(b"1")
    objects = dimensions.listed_objects(spark, str(tmp_path / "store"))
    plan = dimensions.backfill_plan(objects, spark.createDataFrame([("objects/none",)], "object_key string"))
    assert sorted((r.object_key, r.size, r.sha256, r.file_ext, r.outcome) for r in plan.collect()) == [(f"objects/ab/cd/{sha}.PDF", 5, sha, ".pdf", "insert"), ("objects/odd.txt", 1, None, ".txt", "unreadable")]
    (tmp_path / "q.xlsx").write_bytes(files.write_xlsx({"a": [["no"]], "定额条目": [["banner"], ["类型", "项目编码", "名称"], ["定", "X1", "挖土"], ["工"]]}))
    rows = dimensions.standard_rows(files.read_xlsx(spark.read.format("binaryFile").load(str(tmp_path / "q.xlsx")))).orderBy("row_no").collect()
    assert [(r.cells[:3], len(r.cells)) for r in rows] == [(["定", "X1", "挖土"], 9), (["工", None, None], 9)]


def test_alignment_takes_the_greatest_score(spark):
    """A candidate that shares no bigram but has the unit beats one that shares few and has another; the smaller id wins ties."""
    from folioflow.operators import joins

    def brute(name, unit, category, known, others=False):
        grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} or {t} - {""}
        best = None
        for i, c, n, u in sorted(known):
            if c == category and not (others and n == name):
                a, b = grams(name), grams(n)
                score = 0.8 * (len(a & b) / max(len(a), len(b)) if a and b else 0.0) + 0.2 * (1.0 if u == unit else 0.5)
                if best is None or score > best[0] + 1e-12:
                    best = (score, i)
        return best

    known = [(1, "m", "abqrstuvwxyzqrsx", "t"), (2, "m", "zzzyyy", "m3"), (3, "m", "zzzyyy", "m3"), (4, None, "ab", "t"), (5, "n", "q", "t"), (6, "m", "abcd", "kg"), (7, "m", "other", "t")]
    rows = [(k, *r) for k, r in enumerate([("m", "abcdefghijklmnop", "m3"), ("m", "abcdefghijklmnop", "x"), (None, "abc", "t"), ("k", "ab", "t"), ("n", "zzz", "t"), ("m", "zzzyyy", "m3"), ("m", "", "kg"), ("m", "abcd", "t"), ("m", "other", "t")])]
    for others in (False, True):
        frames = spark.createDataFrame(rows, "id int, category string, name string, unit string"), spark.createDataFrame(known, "candidate_id int, category string, name string, unit string")
        got = {r.id: (r.candidate_id, round(r.score, 9)) for r in joins.aligned(*frames, others=others).collect()}
        want = {i: brute(n, u, c, known, others) for i, c, n, u in rows}
        assert got == {i: (b[1], round(b[0], 9)) if b else (None, 0.0) for i, b in want.items()}
