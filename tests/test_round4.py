"""What the findings of round 4 named."""

import re
from collections import Counter
from itertools import groupby

from pyspark.sql import functions as F

from folioflow.operators import sequences
from folioflow.plans import norm_queries  # noqa: F401
from folioflow.plans.driver_queries import QUERIES
from folioflow.plans.norm_tables import Form, parse
from folioflow.sources.tables import table_rows, whole_tables


def left_out(codes):
    """prefix and number of what is missing, as the SQL tells it: one gap after another."""
    out = []
    for prefix in sorted({c[0] for c in codes}):
        told = sorted({c[1:] for c in codes if c[0] == prefix})
        for a, b in zip(told, told[1:]):
            out += [(prefix, prefix + str(n).zfill(4)) for n in range(int(a) + 1, int(b))]
    return Counter(out)


def test_missing_numbers_that_are_alike_stand_together(spark):
    codes = [f"{p}{n}" for p, every in (("A", 7), ("B", 11)) for n in range(1, 3000, every)]
    out = sequences.sequence_gaps(spark.createDataFrame([(c,) for c in codes], "code string"), "code")
    parts = out.rdd.map(tuple).glom().collect()
    assert Counter(r for p in parts for r in p) == left_out(codes)
    runs = sum(1 for p in parts for _ in groupby(p))
    # So a number is one run of a task, and takes next to nothing where the rows are written.
    assert runs == len({r for p in parts for r in p}) < sum(map(len, parts)) / 10


def test_pieces_of_few_rows_make_the_same_gaps(spark, monkeypatch):
    codes = ["A1", "A10", "A100", "A2", "A20", "A200", "A3", "A33", "B5", "B5000"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string")
    for chunk in (1, 2, 7):
        monkeypatch.setattr(sequences, "GAP_CHUNK", chunk)
        assert Counter(map(tuple, sequences.sequence_gaps(rows, "code").collect())) == left_out(codes)
    assert sequences.gap_counts(rows, "code").agg(F.max("times")).first()[0] > 1


CODES = '<tr><td colspan="4">定额编号</td><td>AA0001</td><td>AA0002</td></tr>'
HEAD = CODES + '<tr><td colspan="4">项目</td><td>wall</td><td>$\\phi$ 10</td></tr><tr><td colspan="4">人工费(元)</td><td>4</td><td>-</td></tr><tr><td colspan="4">安全费</td><td>2</td><td>3</td></tr><tr><td>名称</td><td></td><td>单位</td><td>单价</td><td colspan="2">量</td></tr>'
BRICK = '<tr><td rowspan="2">材料</td><td>brick</td><td>m3</td><td>10</td><td>1</td><td>2</td></tr><tr><td>其他材料费</td><td>%</td><td>-</td><td>5</td><td>6</td></tr>'
BOOKS = [
    ("pages", f"单位：t\n<table>{HEAD}{BRICK}</table>go on<table>{CODES}{BRICK}</table><table>{CODES.replace('AA0002', 'AA0009')}{BRICK}</table>"),
    ("one", f"<table><tr><td>lost</td></tr></table><table>{HEAD}{BRICK}{HEAD.replace('AA', 'BB')}{BRICK}</table>"),
    ("refused", f"<table>{HEAD}{BRICK}<tr><td>材料</td><td>nails</td><td></td><td></td><td></td><td></td></tr></table><table>{CODES}{BRICK}</table>"),
    ("none", None),
]


def test_whole_tables_and_their_rows_parse_alike(spark):
    frame = spark.createDataFrame(BOOKS, "file string, text string")
    for form in (Form(fees="missing", material_fee="missing-in-file", unit_from_title=True), Form(more_fees={"安全费": "安全 $x$"})):
        made = [parse(f(frame, "file", "text"), form) for f in (whole_tables, table_rows)]
        lines, again = ([tuple(r) for r in m.lines.orderBy("file", "table_no", "part", "item", "slot", "place").collect()] for m in made)
        assert lines == again and {r[0] for r in lines} == {"pages", "one", "refused"}
        assert made[0].issues.collect() == made[1].issues.collect() and made[0].issues.count() == 1
        assert [r[8] for r in lines if "安全" in r[8]] == (["安全 x"] * 6 if form.more_fees else [])


def test_norm_lines_are_dealt_out_once_by_file(spark):
    out = QUERIES["norm_lines"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # No group of a table, a code or an item is dealt out anew, and what is kept between is columns.
    dealt = re.findall(r"(?<!Broadcast)Exchange (\S+)\(([^()]*)\)", plan)
    assert dealt and {(how, re.sub(r"#\d+L?", "", keys).split(", ")[0]) for how, keys in dealt} == {("hashpartitioning", "file")}
    assert all(len(keys.split(", ")) == 2 for _, keys in dealt) and "ExistingRDD" not in plan
    # A join of large frames would deal them out by all of its keys.
    assert "Join" not in plan
