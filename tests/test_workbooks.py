"""Standard workbooks of parsed books, and byte ranges."""

from pyspark.sql import functions as F
from test_norm_tables import BEFORE, FIRST, HEAD, page

from folioflow.plans.norm_tables import parse
from folioflow.plans.sections import sections
from folioflow.sources import files, workbooks
from folioflow.sources.tables import table_rows


def test_a_book_as_workbooks(spark, tmp_path):
    frame = spark.createDataFrame([("b/1", BEFORE + page(HEAD, FIRST)), ("c", page(HEAD.replace("AA", "BB"), FIRST))], "file string, text string")
    tables = table_rows(frame, "file", "text")
    rows = workbooks.standard_rows(parse(tables).lines, sections(tables.where("row = 0"), "letters"))
    made = workbooks.workbooks(rows.repartition(5), limit=4)
    found = workbooks.saved(made, str(tmp_path / "out")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["b_1-0.xlsx", "b_1-1.xlsx", "b_1-2.xlsx", "b_1-3.xlsx", "c-0.xlsx", "c-1.xlsx", "c-2.xlsx"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.path.rsplit("/", 1)[1] for r in found)
    # 13 rows: a section, and for each item its row, four lines and a blank
    assert sum(r.n_rows for r in found if "/b_1" in r.path) == 13 and sum(r.n_rows for r in found if "/c-" in r.path) == 12
    whole = workbooks.workbooks(rows).where("file = 'b/1'").first()
    (tmp_path / "whole.xlsx").write_bytes(whole.content)
    cells = files.read_xlsx(spark.read.format("binaryFile").load(str(tmp_path / "whole.xlsx"))).collect()
    texts = " ".join(str(r) for r in cells)
    assert all(t in texts for t in ("项目编码", "A.1", "Walls", "AA0001", "AA0002", "brick", "企业管理费"))
    assert workbooks.workbooks(rows.where("file IS NULL")).count() == 0


def test_byte_ranges(spark):
    cases = {"bytes=0-3": (0, 3, b"0123"), "bytes=7-": (7, 9, b"789"), "bytes=-2": (8, 9, b"89"), "bytes=5-99": (5, 9, b"56789"), "bytes=-99": (0, 9, b"0123456789"), "bytes=10-": None, "bytes=4-2": None, "bytes=0-1,3-4": None, "x": None, "bytes=-": None}
    frame = spark.createDataFrame([(k, b"0123456789") for k in cases], "h string, c binary")
    got = {r.h: r.x and (r.x.start, r.x.stop, bytes(r.x.bytes)) for r in frame.select("h", workbooks.byte_range(F.col("c"), F.col("h")).alias("x")).collect()}
    assert got == cases
    assert spark.range(1).select(workbooks.byte_range(F.lit(b""), F.lit("bytes=0-"))).first()[0] is None
