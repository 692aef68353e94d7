"""Norm tables: items and their resource lines out of tables with spanning cells.

A table is a row of the frame, with its rows as placed by the reader. What it says once (its item codes, its base prices,
its fees) is found with array functions over its rows, and a line's parts on its own row, so the rows' wide grids are never
dealt out. Items and resource rows are stored as columns and dealt out once by file: tables that go on over pages meet their
beginning by (file, code) there, and no file is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.functions.patterns import clean_name
from folioflow.functions.text import markup_unit, number_or_zero, out_of_brackets, plain_number
from folioflow.operators.graph import stored
from folioflow.operators.sequences import SO_FAR

# Labels as the books print them.
CODE_ROW = "定额编号"
BASE_LABELS = ("综合基价", "综合单价", "基价(元)", "基价（元）", "综 合 基 价", "基 价 (元)", "基 价（元）", "基 价(元)")
FULL_COST_LABELS = ("全费用(元)", "全费用（元）", "全费用")
CATEGORIES = ("材", "料", "机", "机具", "材 料", "材料", "机 具", "机 械", "料 料", "机械")
MORE_CATEGORIES = ("未计价", "附项", "人工")
CONTINUES_WITH = ("材料", "机具", "工", "未计价", "配")
#: One of them is in each label of base prices, units and fees above and in facts.
SIGNS = ("价", "费", "位", "利", "税")
IMPLICIT_LABELS = ("人工", "材料", "机械", "材", "料", "机", "机具")
MACHINE_FEES = ("机械费", "施工机具使用费", "机具费")
OTHER_MATERIAL = ("其他材料费", "其它材料费")
OTHER_MACHINE = ("其他机具费", "其它机具费")
NUMERIC = r"^[\d,.\s]+$"
DASHES = r"^[\-−–—]+$"

TABLE = ["file", "table_no"]
PART = [*TABLE, "part"]


@dataclass(frozen=True)
class Form:
    """How a book sets its tables.

    code: pattern of an item code. layout: what stands before the quantities: "name" (name, unit, price, with or without a
    category and a code before), "coded" (the same, and labour has a code column), "unpriced" (category, code, name, unit) or
    "price-last" (the price is the last column). fees: whether labour and machine fees are lines "always", only if the table
    has no line of their kind ("missing"), or never ("none"; such books have no sums). material_fee: the material fee is a
    line if there is unpriced material or none at all ("unpriced", and it counts), if there is no material line
    ("missing"), nor one for the item in the whole file ("missing-in-file"), or never ("none").
    """

    code: str = r"[A-Z]{1,2}\d{4}"
    layout: str = "name"
    fees: str = "always"
    material_fee: str = "unpriced"
    machine_fees: tuple[str, ...] = MACHINE_FEES
    appendix_last: bool = False
    brackets_unpriced: bool = False
    quantities_after_price: bool = False
    header_implied: bool = False
    unit_from_title: bool = False
    numbers_in_titles: bool = True
    labour_names: tuple[str, ...] = ()
    machine_units: tuple[str, ...] = ()
    labour_fee_forced: bool = False
    joins_pages: bool = True
    more_fees: dict[str, str] = field(default_factory=dict)


def _any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _cell(text: Column, start: Column, stop: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


_CELLS = "array<struct<text:string,start:int,stop:int>>"


def _merged(cells: Column) -> Column:
    """Cells of which neighbours with the same text, side by side, are one."""

    def add(done: Column, cell: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        one = F.array(_cell(last["text"], last["start"], cell["stop"]))
        return F.when((last["text"] == cell["text"]) & (last["stop"] + 1 == cell["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), one)).otherwise(F.concat(done, F.array(cell)))

    return F.aggregate(cells.cast(_CELLS), F.array().cast(_CELLS), lambda done, cell: add(done, cell).cast(_CELLS))


def _with(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with more columns, each worked out once for a row: filters above don't repeat their expressions below."""
    return frame.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def gathered(rows: DataFrame) -> DataFrame:
    """Table rows (file, table_no, row, prefix, grid, cells) as one row a table, the form of sources.tables.whole_tables."""
    told = F.sort_array(F.collect_list(F.struct("row", "grid", "cells")))
    return rows.where(F.size("grid") >= 4).groupBy(*TABLE).agg(F.max("prefix").alias("prefix"), told.alias("rows"))


def split_tables(tables: DataFrame) -> DataFrame:
    """(file, table_no, part, prefix, many, rows): part 0 has all rows of a table; where several tables were printed as one
    (many), each is a part from 1 on with its own rows, and rows before the first are gone."""
    tables = tables.where("file IS NOT NULL").select(*TABLE, "prefix", F.filter("rows", lambda r: F.size(r["grid"]) >= 4).alias("rows"))
    begins = F.filter(F.transform("rows", lambda r, i: F.when(F.get(r["grid"], F.lit(0)) == CODE_ROW, i)), lambda i: i.isNotNull())
    tables = _with(tables, begins=begins)
    own = lambda b, k: F.slice("rows", b + 1, F.coalesce(F.get("begins", k + 1), F.size("rows")) - b)
    several = F.transform("begins", lambda b, k: F.struct((k + 1).alias("part"), F.lit(True).alias("many"), own(b, k).alias("rows")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("many"), F.col("rows")))
    return tables.select(*TABLE, "prefix", F.inline_outer(F.when(F.size("begins") > 1, several).otherwise(one)))


def facts(parts: DataFrame, form: Form) -> DataFrame:
    """parts with what each says once: projects (its codes in reading order, each with its column), the first rows of base
    prices, units and fees, the titles above the items, where its lines begin, and whether it names a base price. Parts
    without a code are gone."""
    told = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), r["grid"].alias("grid"), F.array_join(F.filter(r["grid"], lambda t: t != ""), " ").alias("text")))
    parts = _with(parts, told=told)
    more = lambda r: (F.regexp_replace(r["text"], r"\s+", "").alias("tight"), F.get(r["grid"], F.lit(0)).alias("col0"), F.coalesce(F.get(r["grid"], F.lit(2)), F.lit("")).alias("col2"))
    parts = _with(parts, each=F.transform("told", lambda r: F.struct(r["row"].alias("row"), r["grid"].alias("grid"), r["text"].alias("text"), *more(r))))
    numeric_from = lambda r, k: F.exists(F.filter(F.slice(r["grid"], k + 1, 1 << 20), lambda t: t != ""), lambda t: t.rlike(NUMERIC))
    machine = lambda r: _any_in(r["tight"], form.machine_fees)
    has = lambda r, w: F.contains(r["tight"], F.lit(w))
    holds = lambda w: lambda r: has(r, w)
    conditions = {
        "base": lambda r: (_any_in(r["text"], BASE_LABELS) & numeric_from(r, 4)) | (_any_in(r["text"], FULL_COST_LABELS) & numeric_from(r, 0)),
        "units": lambda r: F.contains(r["text"], F.lit("计量单位")) | F.contains(r["text"], F.lit("计 量 单 位")),
        "labour": lambda r: has(r, "人工费"),
        "material": lambda r: has(r, "材料费") & ~has(r, "人工费") & ~machine(r) & ~has(r, "管理费") & ~has(r, "利润") & ~has(r, "一般风险费"),
        "machine": machine,
        "management": lambda r: has(r, "管理费"),
        "profit": lambda r: has(r, "利") & ~has(r, "管理"),
        "fee": lambda r: has(r, "费用") & ~has(r, "管理费") & ~has(r, "全费用"),
        "vat": lambda r: has(r, "增值税"),
        "risk": lambda r: has(r, "一般风险费"),
        **{f"more_{k}": holds(label) for k, label in enumerate(form.more_fees)},
    }
    # Few rows hold any of the signs and labels that these ask for.
    parts = _with(parts, signed=F.filter("each", lambda r: _any_in(r["tight"], (*SIGNS, *form.machine_fees, *form.more_fees))))
    found = [_first(F.filter("signed", c))["grid"].alias(n) for n, c in conditions.items()]
    is_code = lambda t: t.rlike(f"^(?:{form.code})$")
    codes = lambda r: F.filter(F.transform(r["grid"], lambda t, i: F.struct(r["row"].alias("row"), i.alias("col"), t.alias("code"))), lambda x: is_code(x["code"]))
    tight0 = lambda r: F.replace(r["col0"], F.lit(" "), F.lit(""))
    header = lambda r: r["col0"].startswith("名 称") | r["col0"].startswith("名称") | tight0(r).startswith("工料机名称") | (r["col0"].isin("", "分类") & (r["col2"] == "名称"))
    first = lambda c: _first(F.filter("each", c))["row"]
    starts = first(header) + 1
    if form.header_implied:
        starts = F.coalesce(starts, first(lambda r: tight0(r).isin(*IMPLICIT_LABELS)))
    titled = lambda r: r["col0"].rlike(r"^(项目|项 目)(?!\s*编)") | (r["col0"] == "子目名称")
    names_base = lambda r: (F.contains(r["text"], F.lit("基价")) & r["text"].rlike("[元(（]")) | _any_in(r["text"], ("综合基价", "综合单价"))
    out = _with(parts, hits=F.flatten(F.transform(F.filter("rows", lambda r: F.exists(r["grid"], is_code)), codes)))
    out = _with(out.where("size(hits) > 0"), ids=F.transform("hits", lambda h: h["code"]))
    ids = F.col("ids")
    firsts = F.filter("hits", lambda h, i: F.array_position(ids, h["code"]) == i + 1)
    return out.select(
        *PART, "prefix", "many", "rows", F.transform(firsts, lambda h, i: F.struct(i.alias("item"), h["code"].alias("code"), h["col"].alias("col"))).alias("projects"),
        F.array_max(F.transform("rows", lambda r: F.size(r["grid"]))).alias("width"), *found, starts.alias("lines_from"), first(lambda r: r["col0"].isin(*CONTINUES_WITH)).alias("goes_on_from"),
        F.transform(F.filter("each", titled), lambda r: F.struct(r["row"].alias("row"), r["grid"].alias("grid"))).alias("titles"), F.exists("signed", names_base).alias("names_base"),
        F.exists("each", lambda r: r["col0"].isin("机", "机具", "机 具")).alias("has_machine_rows"), F.exists("each", lambda r: r["col0"].isin("材", "料", "材料", "材 料")).alias("has_material_rows"),
    )


def _fee_columns(form: Form) -> list[str]:
    return ["labour", "material", "machine", "management", "profit", "fee", "vat", "risk", *[f"more_{k}" for k in range(len(form.more_fees))]]


def items_and_rows(known: DataFrame, form: Form) -> DataFrame:
    """A row for each item of a part, with p (its project) and said (what its table says), and one for each table row that
    may be a resource, with its row, grid and cells; the others of these are null."""
    said = ["prefix", "base", "units", "titles", *_fee_columns(form), "names_base", "has_machine_rows", "has_material_rows"]
    of_row, project = known.schema["rows"].dataType.elementType, known.schema["projects"].dataType.elementType
    none = lambda kind: F.lit(None).cast(kind)
    items = F.transform("projects", lambda p: F.struct(p.alias("p"), F.struct(*said).alias("said"), *[none(f.dataType).alias(f.name) for f in of_row.fields]))
    found = F.filter("rows", lambda r: r["row"] >= F.least("lines_from", "goes_on_from"))
    rows = F.transform(found, lambda r: F.struct(none(project).alias("p"), none(StructType([known.schema[c] for c in said])).alias("said"), *[r[f.name].alias(f.name) for f in of_row.fields]))
    return known.select(*PART, "many", "projects", "width", "lines_from", "goes_on_from", F.inline_outer(F.concat(items, rows)))


def _category(raw: Column, rest: Column, form: Form) -> Column:
    tight = F.replace(raw, F.lit(" "), F.lit(""))
    labelled = raw.isin(*CATEGORIES) | tight.isin(*MORE_CATEGORIES)
    by_label = F.when(tight == "未计价", "未计价").when(tight == "人工", "工").when(F.contains(tight, F.lit("机")), "机").otherwise("料")
    by_label = F.when((by_label == "料") & _first(rest)["text"].rlike(r"^99\d{7,8}$"), "机").otherwise(by_label)
    by_prefix = F.when(raw.rlike(r"^机\s"), "机").when(raw.rlike(r"^[材料]\s"), "料").when(raw.rlike(r"^[未计价]\s"), "未计价").otherwise("料")
    out = F.when(labelled, by_label).otherwise(by_prefix)
    if form.layout == "price-last":
        out = F.when(raw == "人工费", "工").when(raw.isin("机械", "机械费"), "机").when(raw.isin("材料", "材料费"), "料").otherwise(out)
    if form.layout == "unpriced":
        out = F.when(tight == "人工", "工").when(tight.isin("材料", "材", "料"), "料").when(tight.isin("机械", "机", "机具"), "机")
    return out


def told_rows(rows: DataFrame, form: Form) -> DataFrame:
    """(file, table_no, part, i, r, name) for items_and_rows: i is an item with its unit, base price and fees, r a resource
    with its category, unit, price, amounts (one for each of the table's projects) and what kind of line it is; one of them is
    null. A row whose first cells come from above gets them from its grid, rows that are no resources are gone, and names
    are written out."""
    is_item = F.col("row").isNull()
    whole, own = F.transform("grid", lambda t, i: _cell(t, i, i)), F.transform("cells", lambda c: _cell(c["text"], c["start"], c["stop"]))
    rows = _with(rows, own=F.when(F.col("many"), _merged(whole)).otherwise(own.cast(_CELLS)))
    first_start = _first(F.col("own"))["start"]
    above = F.filter(F.transform(F.slice("grid", F.lit(1), F.coalesce(first_start, F.lit(0))), lambda t, i: _cell(t, i, i)), lambda c: c["text"] != "")
    rows = _with(rows, every=F.when(first_start > 0, _merged(F.concat(above.cast(_CELLS), "own"))).otherwise(F.col("own")))
    rows = _with(rows, full=F.filter("every", lambda c: c["text"] != ""))
    rows = _with(rows, head=_first(F.col("full"))).where(is_item | F.col("head").isNotNull())
    raw, rest = F.col("head.text"), F.col("rest")
    tight = F.replace(raw, F.lit(" "), F.lit(""))
    rows = _with(rows, rest=F.filter("full", lambda c: c["start"] > F.col("head.stop")), appendix=tight == "附项", coded_labour=(raw == "人工") if form.layout == "coded" else F.lit(False))
    labelled = raw.isin(*CATEGORIES) | tight.isin(*MORE_CATEGORIES)
    if form.layout == "price-last":
        labelled = labelled | raw.isin("人工费", "材料", "机械", "材料费", "机械费")
    after_code = F.when((F.size(rest) >= 2) & _first(rest)["text"].rlike(r"^\d{6,12}$"), F.get(rest, F.lit(1))).otherwise(_first(rest))
    bare = _cell(F.regexp_replace(raw, r"^[材料机未计价]\s+", ""), F.col("head.start"), F.col("head.stop"))
    name = F.when(F.col("coded_labour"), F.when(F.size(rest) >= 4, F.get(rest, F.lit(1)))).when(labelled, after_code).otherwise(bare)
    if form.layout == "unpriced":
        rows = _with(rows, code_stop=_first(F.filter(rest, lambda c: c["text"].rlike(r"^\d{6,12}$")))["stop"])
        name = _first(F.filter(rest, lambda c: c["start"] > F.col("code_stop")))
    rows = _with(rows, category=_category(raw, rest, form), name_cell=name).where(is_item | (F.col("category").isNotNull() & (F.col("name_cell.text") != "")))
    rows = _with(rows, unit_cell=_first(F.filter("full", lambda c: c["start"] > F.col("name_cell.stop"))))
    rows = _with(rows, unit=F.coalesce(markup_unit(F.col("unit_cell.text")), F.lit("")), unit_stop=F.coalesce("unit_cell.stop", "name_cell.stop"))
    if form.layout == "unpriced":
        rows = rows.where(is_item | F.col("unit_cell").isNotNull())
    after_unit = lambda filled: _first(F.filter("every", lambda c: (c["start"] > F.col("unit_stop")) & (~F.lit(filled) | (c["text"] != ""))))
    price_cell = F.when(F.col("coded_labour"), after_unit(True)).otherwise(after_unit(False))
    if form.layout == "price-last":
        price_cell = _first(F.filter("every", lambda c: (c["start"] <= F.col("width") - 1) & (c["stop"] >= F.col("width") - 1)))
    if form.layout == "unpriced":
        price_cell = F.when(F.lit(False), price_cell)
    rows = _with(rows, price_cell=price_cell)
    rows = _with(rows, price=F.coalesce(out_of_brackets(F.col("price_cell.text")), F.lit("")), price_stop=F.coalesce("price_cell.stop", "unit_stop"))

    def in_zone(c: Column) -> Column:
        if form.quantities_after_price:
            return c["start"] > F.col("price_stop")
        return c["start"] >= F.col("unit_stop") if form.layout == "unpriced" else ~F.col("coded_labour") | (c["start"] > F.col("price_stop"))

    def amount(p: Column) -> Column:
        return F.coalesce(_first(F.filter("every", lambda c: in_zone(c) & (c["start"] <= p["col"]) & (c["stop"] >= p["col"])))["text"], F.lit(""))

    lone = _first(F.filter("every", lambda c: (c["start"] > F.col("price_cell.stop")) & out_of_brackets(c["text"]).rlike(NUMERIC)))["text"]
    undashed = lambda t: F.when(t.rlike(DASHES), "").otherwise(t)
    rows = _with(rows, printed=F.transform("projects", amount), lone=F.coalesce(out_of_brackets(lone), F.lit("")))
    rows = _with(rows, amounts=F.transform("printed", lambda t: undashed(out_of_brackets(t))), bracketed=F.exists("printed", lambda t: t.rlike(r"^[（(]")) & ~F.col("coded_labour") & F.lit(form.layout != "unpriced"))
    rows = rows.withColumn("amounts", F.when((F.size("projects") == 1) & (F.get("amounts", F.lit(0)) == "") & F.col("price_cell").isNotNull(), F.array("lone")).otherwise(F.col("amounts")))
    name, category, unit, price, bracketed = F.col("name_cell.text"), F.col("category"), F.col("unit"), F.col("price"), F.col("bracketed")
    labour = (category == "料") & _any_in(name, form.labour_names)
    category = F.when(labour, "工").when((category == "料") & _any_in(unit, form.machine_units), "机").otherwise(category)
    unset = (price == "") | price.rlike(DASHES)
    unpriced = (category.isin("料", "配") & bracketed & unset) if form.brackets_unpriced else F.lit(False)
    other = _any_in(name, OTHER_MATERIAL) & ~F.col("coded_labour")
    appendix = F.col("appendix")
    if form.layout == "unpriced":
        other, appendix = ((unit == "%") | other) & (category != "工"), _any_in(name, OTHER_MACHINE) & ~((unit == "%") & (category == "工"))
    else:
        price = F.when(other & (unit == "%"), "").when(other & unset, "1.000").otherwise(price)
    row, begins = F.col("row"), F.coalesce(F.col("row") >= F.col("lines_from"), F.lit(False))
    category = F.when(unpriced, "未计价").otherwise(category)
    refusal = F.when(begins & (unit == ""), F.struct("part", "row", _first(F.col("projects"))["code"].alias("code"), F.concat(F.when(category == "未计价", "主材行缺少单位: ").otherwise("料行缺少单位: "), name).alias("reason")))
    resource = F.struct(
        "row", begins.alias("begins"), F.coalesce((row >= F.col("goes_on_from")) & (category != "未计价"), F.lit(False)).alias("goes_on"), refusal.alias("refusal"), category.alias("category"), "unit", price.alias("price"), "amounts",
        other.alias("other"), appendix.alias("appendix"), ((bracketed | labour) & ~unpriced).alias("proportion"), _any_in(name, ("【机械】", "【机】")).alias("of_machines"),
    )
    item = _item(form)
    return rows.select(*PART, F.when(is_item, item).alias("i"), F.when(~is_item, resource).alias("r"), F.when(is_item, F.array_join(_titles(form), " ")).otherwise(name).alias("name")).withColumn("name", clean_name(F.col("name")))


def _value(quantity: Column, price: Column) -> Column:
    """Quantity times price; a quantity without a price is a sum of money itself."""
    return F.when(quantity == 0, 0.0).when(price == 0, quantity).otherwise(quantity * price)


def _fee_value(grid: Column, projects: Column, col: Column) -> Column:
    """A fee's text for an item: its column's, or the row's first number in a table of one item."""
    numbers = F.filter(F.slice(grid, 2, 1 << 20), lambda t: t.rlike(NUMERIC) & (t != ""))
    text = F.when(F.size(projects) == 1, F.coalesce(_first(numbers), F.lit(""))).otherwise(F.coalesce(F.get(grid, col), F.lit("")))
    text = out_of_brackets(text)
    return F.when(text.rlike(DASHES), "").otherwise(F.coalesce(text, F.lit("")))


def _title(titles: Column, col: Column, numbers: bool) -> Column:
    """An item's parts of the titles as an array, without repeats of what stands right above."""
    texts = F.transform(titles, lambda t: F.struct((t["grid"][0] == "子目名称").alias("sub"), F.regexp_replace(F.coalesce(F.get(t["grid"], col), F.lit("")), r"^(项目|项 目|子目名称)\s*", "").alias("text")))
    kept = F.filter(texts, lambda t: (t["text"] != "") & ~t["text"].isin("定额编号", "项目编码", "项目编 号") & (t["sub"] | F.lit(numbers) | ~t["text"].rlike(r"^[\d.,\s]+$")))
    return F.transform(F.filter(kept, lambda t, i: (i == 0) | (F.get(kept, i - 1)["text"] != t["text"])), lambda t: t["text"])


def _titles(form: Form) -> Column:
    return _title(F.col("said.titles"), F.col("p.col"), form.numbers_in_titles)


def _item(form: Form) -> Column:
    """An item of items_and_rows with its unit, base price and fees."""
    col, projects = F.col("p.col"), F.col("projects")
    prefix = F.coalesce("said.prefix", F.lit(""))
    content = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(prefix, r"(?s)^.*工作内容[：:]\s*(.*)$", 1), r"(?s)单位[：:].*$", ""), r"\s+", " "))
    fallback = markup_unit(F.trim(F.regexp_extract(prefix, r"(?s)^.*单位[：:]\s*([^\n]+)", 1)))
    see_table = lambda t: t.rlike(r"^见\s*表$")
    own_unit = F.coalesce(markup_unit(F.get("said.units", col)), F.lit(""))
    if form.unit_from_title:
        last = F.coalesce(markup_unit(F.try_element_at(F.filter(_titles(form), lambda t: t != ""), F.lit(-1))), F.lit(""))
        better = (last != "") & ~see_table(last)
        own_unit = F.when(see_table(own_unit) & better, last).otherwise(own_unit)
        fallback = F.when(see_table(fallback) & better, last).otherwise(fallback)
    base = F.coalesce(F.get("said.base", col), F.lit(""))
    alone = F.coalesce(_first(F.filter(F.slice("said.base", 2, 1 << 20), lambda t: t.rlike(NUMERIC) & (t != ""))), F.lit(""))
    base = out_of_brackets(F.when((base == "") & (F.size(projects) == 1), alone).otherwise(base))
    return F.struct(
        "p.item", "p.code", content.alias("content"), F.when(F.col("said.units").isNotNull(), own_unit).otherwise(fallback).alias("unit"), F.coalesce(base, F.lit("")).alias("base"),
        *[F.when(F.col(f"said.{f}").isNotNull(), _fee_value(F.col(f"said.{f}"), projects, col)).alias(f) for f in _fee_columns(form)], "said.names_base", "said.has_machine_rows", "said.has_material_rows",
    )


def _line(slot, place: list, kind: Column, name: Column, unit: Column, quantity: Column, price: Column, value, counted, code: Column | None = None, feature: Column | None = None, share=False, q=None, basis=0.0) -> Column:
    """A line of an item. counted: what of it counts in the sum, null for its value; share: its value is q percent of the
    sum of the item's basis."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = {"slot": (slot, "int"), "place": (F.array(*[as_column(p).cast("int") for p in place]), "array<int>"), "kind": (kind, "string"), "code": ("" if code is None else code, "string"), "name": (name, "string")}
    parts |= {"feature": ("" if feature is None else feature, "string"), "unit": (unit, "string"), "quantity": (quantity, "string"), "price": (price, "string"), "value": (value, "double"), "counted": (counted, "double")}
    parts |= {"share": (share, "boolean"), "q": (q, "double"), "basis": (basis, "double")}
    return F.struct(*[as_column(c).cast(kind).alias(n) for n, (c, kind) in parts.items()])


def _fees(form: Form) -> list[Column]:
    """Fee lines of an item i (with has_* flags of what the table and the file list), null where the book's rules have none."""
    text_of = lambda c: F.col(f"i.{c}")
    num = lambda c: number_or_zero(text_of(c))
    labour = F.lit(form.labour_fee_forced or form.fees == "always") | (F.lit(form.fees == "missing") & ~F.col("has_labour"))
    if form.material_fee == "unpriced":
        material = F.col("has_unpriced") | (~F.col("has_material") & (F.coalesce(num("material"), F.lit(0.0)) > 0))
    else:
        material = text_of("material").isNotNull() & ~F.col("has_material") & (num("material") > 0) & F.lit(form.material_fee != "none")
        if form.material_fee == "missing-in-file":
            material = material & ~F.col("file_has_material")
    machine = F.lit(form.fees == "always") | (F.lit(form.fees == "missing") & ~F.col("has_machine") & (num("machine") > 0))
    if form.material_fee == "missing-in-file":
        machine = machine & (F.lit(form.fees == "always") | ~F.col("file_has_machine"))
    # slot, place, column, whether, kind, name, whether it counts, whether the value stands as price
    rules = [(1, 0, "labour", text_of("labour").isNotNull() & labour, "工", "人工费", True, False), (3, 0, "material", material, "料", "材料费", form.material_fee == "unpriced", False), (5, 0, "machine", text_of("machine").isNotNull() & machine, "机", "机械费", form.fees == "always", False)]
    above = [("management", "企业管理费"), ("profit", "利润"), ("fee", "费用"), ("vat", "增值税"), ("risk", "一般风险费"), *[(f"more_{k}", shown) for k, shown in enumerate(form.more_fees.values())]]
    rules += [(7, k, c, text_of(c).isNotNull(), "综", shown, True, True) for k, (c, shown) in enumerate(above)]

    def one(slot, place, column, whether, kind, name, counts, as_price):
        text = F.coalesce(text_of(column), F.lit(""))
        quantity, price = (F.lit("100.00"), text) if as_price else (text, F.lit("1.00"))
        return F.when(F.coalesce(whether, F.lit(False)), _line(slot, [0, place, 0], F.lit(kind), F.lit(name), F.lit("元"), quantity, price, number_or_zero(text), number_or_zero(text) if counts else 0.0))

    return [one(*r) for r in rules]


def _resource(form: Form) -> Column:
    """The line of a resource r: of an item of its own table, or of the item that its table goes on with."""
    of = lambda c: F.col(f"r.{c}")
    category, other, proportion, appendix, on = of("category"), of("other"), of("proportion"), of("appendix"), F.col("goes_on")
    q, m = number_or_zero(F.col("quantity")), number_or_zero(of("price"))
    worth = _value(q, m)
    unpriced = category == "未计价"
    plain = ~other & category.isin("料", "配") & ~proportion & ~appendix & ~of("of_machines")
    summed = ~proportion & (on | (F.lit(form.fees != "none") & ~unpriced))
    share = ~on & summed & other & (of("unit") == "%")
    rank = F.when(appendix, 1).when(category == "机", 2).otherwise(0) if form.appendix_last else F.lit(0)
    slot = F.when(on & F.col("to.overheads"), 6).when(on, 8).when(unpriced, 2).otherwise(4)
    place = [F.when(on, F.col("table_no")).otherwise(0), F.when(on | unpriced, 0).otherwise(rank), of("row")]
    kind = F.when(unpriced, "主材").when((category == "料") & proportion, "配").otherwise(category)
    price = F.when(unpriced, "").otherwise(out_of_brackets(of("price")))
    return _line(slot, place, kind, F.col("name"), of("unit"), F.col("quantity"), price, F.when(summed & ~share, F.when(other, q).otherwise(worth)), F.when(appendix & ~on, 0.0), share=share, q=q, basis=F.when(~on & plain, worth).otherwise(0.0))


@dataclass(frozen=True)
class Parsed:
    """lines in the order of table_no, part, item, slot and place; tables that were refused, with the reason."""

    lines: DataFrame
    issues: DataFrame


def parse(rows: DataFrame, form: Form = Form()) -> Parsed:
    """Items and resource lines of tables, one row each as sources.tables.whole_tables gives them, or of their rows (file,
    table_no, row, prefix, grid, cells), which are gathered by table first.

    An item line (kind 定) has the base price as its price and the sum of what counts as its verify: resources without
    brackets, other material by its own share of the materials before it where its unit is %, and the fees that the book
    counts; appendix lines don't count. A table with a resource without a unit is refused as a whole. A table in which
    every code stands in an earlier table that was not refused, and which names no base price, goes on with these
    items: its lines come before the overheads of the last table that began the item, and count in its sum. Tables of fewer
    than four columns, or without a code, give nothing, nor do rows of no file; no rows give no lines.
    """
    known = facts(split_tables(rows if "rows" in rows.columns else gathered(rows)), form)
    told = stored(told_rows(items_and_rows(known, form), form))
    # Books are dealt out by number, and all that follows stays where they are: every group below is of one file.
    spark = told.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by_file = lambda frame: frame.repartition(n, "file")
    refused = told.where("r.refusal IS NOT NULL").select(*TABLE, "r.refusal").groupBy(*TABLE).agg(F.min("refusal").alias("x"))
    issues = refused.select(*TABLE, "x.code", "x.reason")

    # Which parts go on, and with what: each code's last beginning before
    item = [F.col(f"i.{c}") for c in ("item", "code", "names_base", "has_machine_rows", "has_material_rows")]
    codes = by_file(told.where("i IS NOT NULL OR r.refusal IS NOT NULL").select(*PART, *item, F.col("i.management").isNotNull().alias("overheads"), F.col("r.refusal").isNotNull().alias("bad")))
    codes = codes.withColumn("bad", F.bool_or("bad").over(Window.partitionBy(*TABLE))).where("code IS NOT NULL")
    by_code, by_part = Window.partitionBy("file", "code"), Window.partitionBy(*PART)
    seen = codes.withColumn("first", F.min(F.when(~F.col("bad"), F.col("table_no"))).over(by_code))
    seen = seen.withColumn("file_has_machine", F.bool_or("has_machine_rows").over(by_code)).withColumn("file_has_material", F.bool_or("has_material_rows").over(by_code))
    again = F.coalesce(F.bool_and(F.col("first") < F.col("table_no")).over(by_part), F.lit(False)) & (F.col("part") == 0) & ~F.bool_or("names_base").over(by_part) & F.lit(form.joins_pages)
    seen = seen.withColumn("goes_on", again)
    start = F.when(~F.col("goes_on") & ~F.col("bad"), F.struct("table_no", "part", "item", "overheads"))
    seen = seen.withColumn("to", F.last(start, True).over(by_code.orderBy("table_no", F.desc("part"), F.desc("item")).rowsBetween(*SO_FAR)))
    flags = [F.bool_or(c).alias(c) for c in ("goes_on", "bad", "file_has_machine", "file_has_material")]
    state = seen.groupBy(*PART).agg(*flags, F.sort_array(F.collect_list(F.when(F.col("goes_on"), F.struct("item", "to")))).alias("targets"))

    # Lines of the items that begin, and of the tables that go on with them
    # A part's state comes to its rows as one of them: a join would deal out both by table, and the lines by item again.
    rows = by_file(told.unionByName(state, allowMissingColumns=True))
    rows = rows.select(*told.columns, *[F.first(c, True).over(by_part).alias(c) for c in state.columns if c not in PART]).where("i IS NOT NULL OR r IS NOT NULL")
    rows = rows.withColumn("begins", ~F.col("goes_on") & ~F.col("bad"))
    rows = rows.where((F.col("begins") & (F.col("i").isNotNull() | F.col("r.begins"))) | (F.col("goes_on") & F.col("r.goes_on")))
    listed = {"has_labour": ("工",), "has_material": ("料", "配"), "has_machine": ("机",), "has_unpriced": ("未计价",)}
    rows = rows.select("*", *[F.coalesce(F.bool_or(F.col("begins") & F.col("r.category").isin(*kinds)).over(by_part), F.lit(False)).alias(c) for c, kinds in listed.items()])
    rows = rows.select("*", F.posexplode_outer(F.coalesce("r.amounts", F.array(F.lit(None).cast("string")))).alias("k", "quantity"))
    rows = rows.withColumn("to", F.get("targets", F.col("k"))["to"]).where("begins OR to IS NOT NULL")
    head = _line(0, [0, 0, 0], F.lit("定"), F.col("name"), F.col("i.unit"), F.lit(""), F.col("i.base"), None, 0.0, F.col("i.code"), F.col("i.content"))
    of_item = F.filter(F.array(head, *_fees(form)), lambda x: x.isNotNull())
    place = [F.when(F.col("goes_on"), F.col(f"to.{c}")).otherwise(own).alias(c) for c, own in {"table_no": F.col("table_no"), "part": F.col("part"), "item": F.coalesce("i.item", "k")}.items()]
    lines = rows.select("file", *place, F.inline_outer(F.when(F.col("i").isNotNull(), of_item).otherwise(F.array(_resource(form)))))
    if form.more_fees:
        lines = lines.withColumn("name", F.when(F.col("name").isin(*form.more_fees.values()) & (F.col("slot") == 7), clean_name(F.col("name"))).otherwise(F.col("name")))

    by_item = Window.partitionBy(*PART, "item")
    lines = lines.withColumn("value", F.when(F.col("share"), F.sum("basis").over(by_item) * F.col("q") / 100).otherwise(F.col("value")))
    lines = lines.withColumn("counted", F.coalesce("counted", plain_number(F.col("value")).cast("double"), F.lit(0.0)))
    shown = F.when(F.col("kind") != "定", F.col("value")).when(F.lit(form.fees != "none"), F.sum("counted").over(by_item))
    lines = lines.withColumn("verify", F.coalesce(plain_number(shown), F.lit("")))
    return Parsed(lines.drop("value", "counted", "share", "q", "basis"), issues)
