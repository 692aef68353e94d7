"""Norm tables: spans, layouts, fees, refusals, tables printed as one and tables over pages."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioflow.functions.patterns import COMMANDS, Automaton, clean_name, rewritten
from folioflow.plans.norm_tables import Form, parse
from folioflow.sources.tables import placed, table_rows

CODES = '<tr><td colspan="4">定额编号</td><td>AA0001</td><td>AA0002</td></tr>'
HEAD = CODES + """
<tr><td colspan="4" rowspan="2">项目</td><td colspan="2">Brick wall</td></tr><tr><td>$\\phi$10</td><td>thick</td></tr>
<tr><td colspan="4">综合基价(元)</td><td>1,050.00</td><td>163.00</td></tr>
<tr><td rowspan="3">其中</td><td colspan="3">人工费(元)</td><td>40.00</td><td>-</td></tr><tr><td colspan="3">材料费(元)</td><td>1000</td><td>40</td></tr><tr><td colspan="3">管理费(元)</td><td>30.00</td><td>3</td></tr>
<tr><td>名称</td><td></td><td>单位</td><td>单价(元)</td><td colspan="2">消耗量</td></tr>"""
FIRST = '<tr><td rowspan="2">材料</td><td>brick</td><td>$m^{3}$</td><td>100.00</td><td>9.5</td><td>0.1</td></tr><tr><td>sand</td><td>t</td><td>50</td><td>1</td><td>(0.5)</td></tr>'
SECOND = "<tr><td>材料</td><td>cement</td><td>t</td><td>10</td><td>3</td><td>(2)</td></tr>"
THIRD = '<tr><td rowspan="2">材料</td><td>其他材料费</td><td>元</td><td>-</td><td>0.00</td><td>40</td></tr><tr><td>water</td><td>m3</td><td>(2.5)</td><td>-</td><td>4</td></tr><tr><td>机械</td><td>mixer</td><td>台班</td><td>10</td><td>-</td><td>1</td></tr>'
BEFORE = "## A.1 Walls\n工作内容：old\n工作内容：mix,\n lay 单位：$10 m^{3}$\n"


def page(*parts):
    return f"<table>{''.join(parts)}</table>"


def lines(spark, texts, form=Form(), columns=("kind", "code", "name", "unit", "quantity", "price", "verify")):
    frame = spark.createDataFrame(texts, "file string, text string")
    parsed = parse(table_rows(frame, "file", "text"), form)
    rows = parsed.lines.orderBy("file", "table_no", "part", "item", "slot", "place").collect()
    return [tuple(r[c] for c in columns) for r in rows], [tuple(r) for r in parsed.issues.collect()]


def test_grid_and_cells():
    rows = placed('<table><tr><td rowspan="2" colspan="2">a <b>b</b>c</td><td>d</td><td>e</td></tr><tr><td colspan="9">f</td></tr><tr><td>g</td></tr></table>')
    assert [r[0] for r in rows] == [["a b c", "a b c", "d", "e"], ["a b c", "a b c", "f", "f"], ["g", "", "", ""]]
    assert [[c[:3] for c in r[1]] for r in rows] == [[("a b c", 0, 1), ("d", 2, 2), ("e", 3, 3)], [("f", 2, 10)], [("g", 0, 0)]]
    assert placed(None) == [] and placed("<table></table>") == []


WHOLE = [
    ("定", "AA0001", "Brick wall φ10", "10m3", "", "1,050.00", "1050"), ("工", "", "人工费", "元", "40.00", "1.00", "40"), ("料", "", "brick", "m3", "9.5", "100.00", "950"), ("配", "", "sand", "t", "1", "50", ""),
    ("配", "", "cement", "t", "3", "10", ""), ("料", "", "其他材料费", "元", "0.00", "1.000", "0"), ("料", "", "water", "m3", "", "2.5", "0"), ("机", "", "mixer", "台班", "", "10", "0"), ("综", "", "企业管理费", "元", "100.00", "30.00", "30"),
]


def test_items_and_lines(spark):
    got, issues = lines(spark, [("f", BEFORE + page(HEAD, FIRST, SECOND, THIRD))])
    assert not issues
    # A bracket in any column makes the row a proportion; the sum of what counts is 40 + 950 + 0 + 0 + 30.
    assert got[:9] == [(*WHOLE[0][:-1], "1020"), *WHOLE[1:]]
    assert got[9][:3] == ("定", "AA0002", "Brick wall thick") and got[9][-1] == "73" and len(got) == 18


def test_a_table_cut_in_pages_equals_the_whole(spark):
    whole, _ = lines(spark, [("f", BEFORE + page(HEAD, FIRST, SECOND, THIRD))])
    cut, issues = lines(spark, [("f", BEFORE + page(HEAD, FIRST) + "\npage 2\n" + page(CODES, SECOND) + page(CODES, THIRD))])
    assert cut == whole and not issues
    # another book's pages, and pages that name a base price or a new code, don't go on
    other, _ = lines(spark, [("f", BEFORE + page(HEAD, FIRST)), ("g", page(CODES, SECOND))])
    assert [r[0] for r in other].count("定") == 4
    apart, _ = lines(spark, [("f", BEFORE + page(HEAD, FIRST) + page(CODES, SECOND))], replace(Form(), joins_pages=False))
    assert [r[0] for r in apart].count("定") == 4


def test_tables_printed_as_one(spark):
    second = HEAD.replace("AA000", "BB000")
    got, _ = lines(spark, [("f", BEFORE + page('<tr><td colspan="6">lost</td></tr>', HEAD, FIRST, second, SECOND, THIRD))], columns=("part", "item", "kind", "code", "name", "quantity", "price"))
    assert [r[3] for r in got if r[2] == "定"] == ["AA0001", "AA0002", "BB0001", "BB0002"] and {r[0] for r in got} == {1, 2}
    alone, _ = lines(spark, [("f", BEFORE + page(second, SECOND, THIRD))], columns=("item", "kind", "code", "name", "quantity", "price"))
    assert [r[1:] for r in got if r[0] == 2] == alone


def test_a_resource_without_a_unit_refuses_the_table(spark):
    bad = "<tr><td>材料</td><td>nails</td><td></td><td></td><td></td><td></td></tr>"
    got, issues = lines(spark, [("f", BEFORE + page(HEAD, FIRST, bad) + page(HEAD.replace("AA", "CC"), FIRST))])
    assert issues == [("f", 0, "AA0001", "料行缺少单位: nails")] and {r[1] for r in got if r[0] == "定"} == {"CC0001", "CC0002"}
    # a table after a refused one begins its items itself
    got, _ = lines(spark, [("f", page(HEAD, bad) + page(CODES, '<tr><td>名称</td><td></td><td>单位</td><td>单价</td><td colspan="2">消耗量</td></tr>', FIRST))])
    assert [r[1] for r in got if r[0] == "定"] == ["AA0001", "AA0002"]


def test_fee_rules(spark):
    no_lines = page(HEAD.replace("<tr><td rowspan=\"3\">其中", '<tr><td colspan="4">机械费</td><td>6</td><td>0</td></tr><tr><td rowspan="3">其中'))
    fees = lambda **k: [(r[0], r[2], r[4]) for r in lines(spark, [("f", no_lines)], Form(**k))[0] if r[0] != "定"][:4]
    assert fees() == [("工", "人工费", "40.00"), ("料", "材料费", "1000"), ("机", "机械费", "6"), ("综", "企业管理费", "100.00")]
    assert fees(fees="missing", material_fee="missing") == fees()
    assert fees(fees="none", material_fee="none")[0][0] == "综"
    sums = lambda **k: [r[-1] for r in lines(spark, [("f", no_lines)], Form(**k))[0] if r[0] == "定"]
    assert sums() == ["1076", "43"] and sums(fees="missing", material_fee="missing") == ["70", "3"] and sums(fees="none", material_fee="none") == ["", ""]


def test_layouts(spark):
    def table(head, *rows, width=6):
        codes = f'<tr><td colspan="{width - 1}">定额编号</td><td>AA0001</td></tr>'
        cells = lambda r: "<tr>" + "".join(f"<td>{c}</td>" for c in r.split("|")) + "</tr>"
        return "<table>" + codes + cells(head) + "".join(map(cells, rows)) + "</table>"

    def got(form, *table_rows_):
        return [r for r in lines(spark, [("f", table(*table_rows_))], form, ("kind", "name", "unit", "quantity", "price", "verify"))[0] if r[0] != "定"]

    coded = got(Form(layout="coded"), "名称||||单价|", "人工|000300010|worker|工日|100|2", "材料|040100010|lime|t|30|(1)", "材料|990100010|jack|台班|50|2")
    assert coded == [("工", "worker", "工日", "2", "100", "200"), ("配", "lime", "t", "1", "30", ""), ("机", "jack", "台班", "2", "50", "100")]
    free = got(Form(layout="unpriced", fees="none", material_fee="none"), "工料机名称|||||", "人工|00010701|worker||工日|2", "机械|99010101|其他机具费||%|5", "x|1|2|3|4|5")
    assert free == [("工", "worker", "工日", "2", "", ""), ("机", "其他机具费", "%", "5", "", "")]
    brackets = got(Form(brackets_unpriced=True), "名称|||||", "材料|duct||m|-|(10.5)", "材料|glue||kg|3|2")
    # where material has no price, the material fee is a line even if the table prints none
    assert brackets == [("主材", "duct", "m", "10.5", "", ""), ("料", "材料费", "元", "", "1.00", "0"), ("料", "glue", "kg", "2", "3", "6")]
    last = got(Form(code="AA0001"), "名称|||||", "附项 |extra||m|2|3")
    assert last == [("料", "extra", "m", "3", "2", "6")]
    assert lines(spark, [("f", table("名称|||||", "附项|extra||m|2|3"))])[0][0][-1] == "0"
    percent = got(Form(), "名称|||||", "材料|a||m|10|3", "材料|其他材料费||%|-|5", "材料|【机械】oil||kg|8|1")
    assert percent[1] == ("料", "其他材料费", "%", "5", "", "1.5")


def test_empty_input(spark):
    assert lines(spark, [("f", None), (None, page(HEAD, FIRST)), ("g", ""), ("h", "<table></table>"), ("i", page(CODES[:20]))]) == ([], [])


@pytest.mark.parametrize("text", ["", "geta", "etau", "\\phi\\leqslant10", "notin into", "\\\\to", "in\\in", "sum of sums", "varepsilon", "tto\\", "leleq"])
def test_rewriting_is_that_of_one_word_after_another(text):
    import re

    want = text
    for word, sign in sorted(COMMANDS, key=lambda p: len(p[0]), reverse=True):
        want = re.sub(r"\\?" + word, sign, want)
    assert rewritten(text, COMMANDS) == want


def test_overlapping_words():
    assert Automaton(["ab", "bcd", "", "ab"]).found("abcdab") == [(1, 4, 1), (4, 6, 0)] and Automaton([]).found("x") == []


def test_clean_name(spark):
    texts = ["$\\mathrm{C} 20$ wall", "$$a$$ \\text{b}{{c}}", "x &lt; y  z", None, "pipe \\phi 20\\relax", "a{b{c}}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_name(F.col("t"))).collect()]
    assert got == ["C 20 wall", "a bc", "x < y z", "", rewritten("pipe \\phi 20", COMMANDS), "ab{c}"]
