"""Rules of single values and small frames, by cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.functions import keys, periods, text
from folioflow.operators import catalog, joins, sequences
from folioflow.plans import ingest, manifest, quality
from folioflow.sources import files


def c(v, kind="string"):
    return F.lit(v).cast(kind)


def test_values(spark):
    day = dt.date
    cases = [
        (text.out_of_brackets(c("(10.500)")), "10.500"), (text.out_of_brackets(c("（1,2）")), "1,2"), (text.out_of_brackets(c("(x)")), "(x)"), (text.out_of_brackets(c(None)), None),
        (text.integral(c(3.0, "double")), "3"), (text.integral(c(2.5, "double")), "2.5"), (text.integral(c(None, "double")), None),
        (text.resource_name(c("ａ( b )")), "a(b)"),
        (text.blob_key(c("abcdef"), c(".pdf")), "objects/ab/cd/abcdef.pdf"),
        (text.safe_path(c(" a/b:c\\d ")), "a_b_c_d"), (text.safe_path(c(None)), None),
        (text.repaired_name(c("信息".encode("gbk").decode("latin-1"))), "信息"), (text.repaired_name(c("plain é")), "plain é"), (text.repaired_name(c("信息")), "信息"), (text.repaired_name(c(None)), None),
        (text.spaced(c("钢筋HRB400级α角")), "钢筋 HRB400 级 α 角"), (text.spaced(c("abc 中")), "abc 中"),
        (text.extension(c("x/Y.PDF")), ".pdf"), (text.extension(c("none")), ""),
        (periods.in_window(c("2024-05"), "2024-01", "2024-05"), True), (periods.in_window(c("2024-06"), None, "2024-05"), False), (periods.in_window(c(None), None, None), True), (periods.in_window(c(None), "2024-01", None), False),
        (periods.period_of(c(None), c("no"), c("2024年5月"), c("2023-01-01")), "2024-05"), (periods.period_of(c(None), c("")), None),
        (periods.region_and_parent(c("510100-xx")), ["510100-xx", "510100"]), (periods.region_and_parent(c("510100")), ["510100"]),
        (periods.province_of(c("510100")), "510000"), (periods.province_of(c("x1")), None),
        (periods.lag_days(c(day(2024, 1, 1), "date"), c(day(2024, 1, 11), "date")), 10), (periods.lag_days(c(day(2024, 1, 11), "date"), c(day(2024, 1, 1), "date")), 0),
        (periods.legal_status(c(None, "date"), c(day(2024, 1, 1), "date")), "unknown"), (periods.legal_status(c(day(2024, 1, 1), "date"), c(day(2024, 1, 1), "date")), "effective"), (periods.legal_status(c(day(2024, 1, 2), "date"), c(day(2024, 1, 1), "date")), "pending"),
        (keys.book_category(c("boq_standard"), c("industry_specialty")), "boq_standard"), (keys.book_category(c("x"), c("construction_regional")), "construction_quota"), (keys.book_category(c(None), c("industry_specialty")), "industry_quota"), (keys.book_category(c("x"), c("y")), None),
        (joins.first_filled(c(" "), c(None), c(" b "), c("d")), "b"), (joins.first_filled(c(""), c(None)), None),
        (catalog.consistent_status(c(0, "int"), c(0, "int"), c(0, "int"), c(0, "int")), "empty"), (catalog.consistent_status(c(3, "int"), c(1, "int"), c(0, "int"), c(0, "int")), "partial"), (catalog.consistent_status(c(3, "int"), c(3, "int"), c(0, "int"), c(0, "int")), "failed"),
    ]
    got = spark.range(1).select(*[e.alias(f"v{k}") for k, (e, _) in enumerate(cases)]).first()
    assert [tuple(x) if isinstance(x, list) else x for x in got] == [tuple(w) if isinstance(w, list) else w for _, w in cases]


def test_leases_by_priority(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("a", "pending", 5, at(1), at(1), None, at(1)), ("b", "running", 1, at(1), at(1), at(2), at(1)), ("c", "running", 1, at(1), at(1), at(9), at(4)), ("d", "pending", 5, None, at(0), None, None),
        ("e", "pending", 5, at(1), at(0), None, None), ("f", "done", 0, at(1), at(1), None, None), ("g", "running", 1, at(1), at(1), None, None),
    ]
    tasks = spark.createDataFrame(rows, "task_id string, status string, priority int, scheduled_at timestamp, created_at timestamp, lease_expires_at timestamp, heartbeat_at timestamp")
    now = F.lit(at(5))
    assert [r.task_id for r in ingest.leasable(tasks, now, 9).collect()] == ["b", "e", "a", "d"]
    assert [r.task_id for r in ingest.leasable(tasks, now, 2).collect()] == ["b", "e"]
    assert sorted(r.task_id for r in ingest.stale(tasks, now).collect()) == ["b", "c"]


def test_small_frames(spark):
    counts = spark.createDataFrame([("51", 2), ("99", 1), (None, 4)], "code string, n int")
    names = spark.createDataFrame([("51", "四川")], "code string, label string")
    assert {r.code: r.label for r in catalog.labelled(counts, "code", names, "label").collect()} == {"51": "四川", "99": "99", None: None}
    order = catalog.ranked(spark.createDataFrame([("b",), ("a",), ("x",), (None,)], "k string"), "k", {"a": 2, "b": 1}).collect()
    assert {r.k: r["rank"] for r in order} == {"b": 1, "a": 2, "x": 9999, None: 9999}
    one, two = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, action string"), spark.createDataFrame([(1, "x"), (3, "z")], "id int, action string")
    assert sorted(tuple(r) for r in manifest.drift(one, two).collect()) == [(1, "x", "planned"), (2, "y", "planned"), (3, "z", "approved")] and manifest.drift(one, one).count() == 0
    rows = spark.createDataFrame([("f", 1, "s", "A Walls....12"), ("f", 2, "s", "A Walls"), ("f", 3, "i", "x"), ("f", 4, "s", "B ……3"), ("f", 5, "s", "C plain")], "file string, n int, kind string, name string")
    assert [r.n for r in sequences.without_contents(rows, "file", "n", "kind", "s").orderBy("n").collect()] == [2, 3, 5]
    lines = spark.createDataFrame([("a", "m", 2.0, 3.0, None, None), ("a", "%", 10.0, None, 50.0, None), ("a", "m", 4.0, 0.0, None, None), ("a", "m", 9.0, 9.0, None, True)], "code string, unit string, quantity double, price double, basis double, excluded boolean")
    assert [r.value for r in quality.line_values(lines).collect()] == [6.0, 5.0, 4.0, 81.0]


def test_registering(spark):
    rows = spark.createDataFrame([("t", "h1", "b", 1), ("t", "h1", "a", 1), ("t", "h2", "c", 2), ("u", "h2", "d", 2)], "tenant string, sha256 string, name string, size int")
    out = ingest.registered(rows, spark.createDataFrame([("h2",)], "sha256 string"), spark.createDataFrame([("u", "h2")], "tenant string, sha256 string")).collect()
    assert sorted((r.tenant, r.sha256, r.name) for r in out) == [("t", "h1", "a"), ("t", "h2", "c"), ("u", "h2", "d")]


def test_manifest_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x,y")], "a int, b string, c string")
    files.export_manifest(rows.coalesce(1), str(tmp_path / "csv"), ["c", "a"], "csv")
    assert next((tmp_path / "csv").glob("part-*")).read_text() == 'c,a\n"x,y",1\n'
    files.export_manifest(rows.coalesce(1), str(tmp_path / "jsonl"), ["b", "a"], "jsonl")
    assert next((tmp_path / "jsonl").glob("part-*")).read_text() == '{"b":null,"a":1}\n'
    with pytest.raises(ValueError):
        files.export_manifest(rows, str(tmp_path / "x"), ["a"], "xml")
