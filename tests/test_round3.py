"""What the findings of the third round asked for: each test failed before its change."""

from pyspark.sql import functions as F

from folioflow.functions.patterns import clean_name
from folioflow.operators import graph, sequences
from folioflow.plans import archives, blob_audit
from folioflow.plans.driver_queries import QUERIES
from folioflow.sources import tables


def test_plain_tables_need_no_parser(monkeypatch):
    plain = '<table border="1"><tr><TD colspan="2" rowspan=" 2 "> a\n b<br/>c</td><th>d &gt</th></tr><tr><td>e</tr></table>'
    odd = ["<table><tr><td rowspan=2>a</td></tr></table>", "<table><tr><td>a &amp; b<!-- c --></td></tr></table>", "<table><td/>x</table>", "", plain]
    plain = plain.replace(" &gt", " > <b>f</b>")

    def parsed(html):
        parser = tables._Spaced()
        parser.feed(html)
        parser.close()
        parser.close_cell()
        return parser.row, parser.cells

    want = [parsed(x) for x in (plain, *odd)]
    assert [tables._cells(x) for x in (plain, *odd)] == want
    monkeypatch.setattr(tables, "_Spaced", None)
    assert tables._cells(plain) == want[0]


def test_names_without_braces_pass_their_patterns_once(spark):
    names = spark.createDataFrame([("$\\phi$ 12",), ("x\\relax y",), ("\\mathrm{C} 2{{0}}",), ("12",), (None,)], "t string").select(clean_name(F.col("t")).alias("n"))
    assert [r.n for r in names.collect()] == ["φ 12", "x y", "C 20", "12", ""]
    plan = names._jdf.queryExecution().analyzed().toString()
    assert plan.count("rlike(") + plan.count("RLIKE") == 0


def test_only_shared_evidence_goes_through_the_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "c"), (9, "c"), (8, "d"), (7, None), (None, "a")], "n long, e string")
    kept, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    assert sorted(map(tuple, graph.components(rows, "n", "e").collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 9)]
    assert sorted((r.n, r.e) for r in kept[0].collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    assert graph.components(rows.where("n > 7"), "n", "e").count() == 2


def test_proofs_of_a_rebuild_are_one_row_for_a_key(spark):
    n = 300
    manifest = spark.range(n).select(
        F.concat(F.lit("h"), "id").alias("sha256"), F.lit("k").alias("object_key"), F.lit("cost_info").alias("domain_types"), F.lit("true").alias("parse_ready"), F.lit("T").alias("archive_titles"), F.lit("").alias("period_raws"), F.lit("2024-01").alias("period_starts"),
        F.lit("").alias("original_names"), F.lit("110000").alias("region_codes"), F.when(F.col("id") == 5, None).otherwise("https://x/a").alias("source_urls"), F.lit("").alias("source_names"),
    )
    sources = spark.createDataFrame([("s1", 1, "110000", "S", None)], "source_id string, seq int, region_code string, name string, publisher_scope string")
    known = lambda source, url: spark.range(n).select(F.lit(source).alias("source_id"), F.lit("110000").alias("region_code"), F.lit("2024-01").alias("period"), F.lit("T").alias("title"), F.lit(url).alias("source_url"), F.concat(F.lit("h"), F.col("id") + 290).alias("sha256"))
    plan = lambda k: archives.rebuild_plan(manifest, sources, k, manifest.select("sha256").where("sha256 = 'h5'"))
    own = plan(known("s1", "HTTPS://X/a"))
    assert dict(own.groupBy("outcome").count().collect()) == {"archive": n - 1, "existing": 1}
    assert dict(plan(known("s1", "HTTPS://X/a").unionByName(known("s0", "HTTPS://X/a"))).groupBy("outcome").count().collect()) == {"cross_source_duplicate": n - 1, "existing": 1}
    assert dict(plan(known("s2", None)).groupBy("outcome").count().collect()) == {"cross_source_duplicate": 10, "archive": n - 11, "existing": 1}
    # Urls that are alike meet as one row, so no join makes rows beyond those asked for.
    assert "min(source_id#" in own._jdf.queryExecution().analyzed().toString()


def test_chunks_of_a_gap_are_dealt_out(spark):
    codes = spark.createDataFrame([("A1",), ("A2500002",)], "code string")
    out = sequences.sequence_gaps(codes, "code")
    assert out.agg(F.count("*"), F.count_distinct("missing")).first()[:] == (2500000, 2500000)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_blob_sections_join_each_side_once(spark):
    assets = spark.createDataFrame([(1, "b1", "s" * 64, 5, "x", "k1"), (2, "b1", "s" * 64, 6, "x", "k2"), (3, None, "t", None, None, None), (4, "b9", "t", 1, "x", ""), (5, "", "", 1, "y", "k1")], "file_id long, blob_hash string, sha256 string, file_size long, bucket string, object_key string")
    blobs = spark.createDataFrame([("b1", 5, "x", "k1")], "blob_hash string, byte_size long, bucket string, object_key string")
    objects = spark.createDataFrame([("x", "k1", 5), ("x", "k2", 5)], "bucket string, object_key string, byte_size long")
    events = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "file_id long, source_id long")
    sources = spark.createDataFrame([(7, "n", "quota"), (8, "m", "other")], "source_id long, name string, data_domain string")
    out = blob_audit.sections(assets, blobs, objects, events, sources)
    got = {(r.section, r.measure): r.n for r in out.collect()}
    assert len(got) == 17
    want = {"total": 5, "blob_hash_set": 3, "blob_hash_null": 2, "blob_exists": 2, "blob_orphan": 1, "blob_conflict": 1, "sha256_empty": 1, "sha256_length_64": 2, "sha256_short": 2, "duplicate_sha_groups": 2, "conflict_groups": 1, "files": 2, "holds": 0, "with_object_key": 3, "exists_ok": 1, "missing": 1, "size_mismatch": 1}
    assert {k[1]: v for k, v in got.items()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 0 and plan.count("Union") == 0


def test_lines_are_dealt_out_by_number(spark):
    out = QUERIES["unnest_lateral"](spark, "/root/testdata/sf0.001")
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_no_value_of_a_manifest_becomes_a_row(spark):
    out = QUERIES["parse_manifest"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
