"""HTML tables as grids of cells."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")


class _Table(HTMLParser):
    """Cells of one table: (row, text, row span, column span)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.row, self.cell, self.cells, self.spans = -1, None, [], (1, 1)

    def close_cell(self):
        if self.cell is not None:
            self.cells.append((self.row, _SPACE.sub(" ", "".join(self.cell)).strip(), *self.spans))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.close_cell()
            self.row += 1
        elif tag in ("td", "th"):
            self.close_cell()
            self.row = max(self.row, 0)
            number = lambda v: max(1, int(v)) if (v or "").strip().isdigit() else 1
            named = dict(attrs)
            self.cell, self.spans = [], (number(named.get("rowspan")), number(named.get("colspan")))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def grid(html: str | None, width: int | None = None) -> list[list[str]]:
    """Rows of equal length with spanning cells filled to the right and down. With a width, columns beyond it are cut."""
    parser = _Table()
    parser.feed(html or "")
    parser.close()
    parser.close_cell()
    taken: dict[tuple[int, int], str] = {}
    at: dict[int, int] = {}
    for row, text, down, right in parser.cells:
        col = at.get(row, 0)
        while (row, col) in taken:
            col += 1
        for r in range(row, row + down):
            for c in range(col, col + right):
                taken.setdefault((r, c), text)
        at[row] = col + right
    rows = parser.row + 1
    cols = max((c + 1 for r, c in taken if r < rows), default=0)
    cols = min(cols, width) if width else cols
    return [[taken.get((r, c), "") for c in range(cols)] for r in range(rows)]


def table_cells(pages: DataFrame, key: str, html: str, width: int | None = None) -> DataFrame:
    """(key, table_no, row, col, text) for every cell of every table in the html."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, found in enumerate(re.findall(r"(?is)<table\b.*?</table>", page or "")):
                    rows += [(k, n, r, c, t) for r, line in enumerate(grid(found, width)) for c, t in enumerate(line)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "table_no", "row", "col", "text"])

    return pages.select(F.col(key).cast("string"), F.col(html)).mapInArrow(run, "key string, table_no int, row int, col int, text string")


class _Spaced(_Table):
    """Texts of inner elements stand apart."""

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(f" {data} ")


def _span(text: str | None) -> int:
    return max(1, int(text)) if (text or "").strip().isdigit() else 1


# Markup that needs no parser: plain elements with quoted attributes, without references, comments or scripts.
_NAMES = "table|thead|tbody|tr|td|th|b|i|u|p|em|strong|span|div|sub|sup"
_PLAIN = re.compile(rf'(?:[^<&]++|<(?:(?:{_NAMES})(?:\s+[a-z][\w-]*="[^"<>&]*")*+\s*|br\s*/?|/(?:{_NAMES})\s*)>)*+', re.I | re.A)
_PIECES = re.compile(r"<(/?)([a-z]+)([^>]*)>([^<]*)", re.I | re.A)
_SPANS = re.compile(r'([a-z][\w-]*)="([^"]*)"', re.I | re.A)


@lru_cache(maxsize=4096)
def _spans(attrs: str) -> tuple[int, int]:
    named = {k.lower(): v for k, v in _SPANS.findall(attrs)}
    return _span(named.get("rowspan")), _span(named.get("colspan"))


def _plain_cells(html: str) -> tuple[int, list[tuple[int, str, int, int]]]:
    """The number of the last row, and the cells of _Spaced, of a table that is plain."""
    row, cells, texts, down, right = -1, [], None, 1, 1
    for end, tag, attrs, text in _PIECES.findall(html):
        tag = tag.lower()
        if tag in ("td", "th", "tr") or (end and tag == "table"):
            if texts is not None:
                cells.append((row, " ".join("".join(texts).split()), down, right))
                texts = None
            if not end:
                if tag == "tr":
                    row += 1
                else:
                    row, texts, down, right = max(row, 0), [], 1, 1
                    if attrs:
                        down, right = _spans(attrs)
        elif tag == "br" and texts is not None:
            texts.append(" ")
        if texts is not None and text and not text.isspace():
            texts.append(f" {text} ")
    return row, cells


def _cells(html: str) -> tuple[int, list[tuple[int, str, int, int]]]:
    """The number of the last row, and the cells as (row, text, row span, column span)."""
    if html.endswith(">") and _PLAIN.fullmatch(html):
        return _plain_cells(html)
    parser = _Spaced()
    parser.feed(html)
    parser.close()
    parser.close_cell()
    return parser.row, parser.cells


def placed(html: str | None) -> list[tuple[list[str], list[tuple[str, int, int, int]]]]:
    """For each table row its grid, spans filled in, and its own cells as (text, first column, last column, row span). The
    first row sets the number of columns; cells beyond it are cut off."""
    last, cells = _cells(html or "")
    width = sum(right for row, _, _, right in cells if row == 0)
    grid: list[dict[int, str]] = [{} for _ in range(last + 1)]
    own: list[list] = [[] for _ in grid]
    at: dict[int, int] = {}
    for row, text, down, right in cells:
        col, line = at.get(row, 0), grid[row]
        while col in line:
            col += 1
        if col >= width:
            continue
        own[row].append((text, col, col + right - 1, down))
        for c in range(col, min(col + right, width)):
            line[c] = text
            if down > 1:
                for below in grid[row + 1 : row + down]:
                    below.setdefault(c, text)
        at[row] = col + right
    return [([line.get(c, "") for c in range(width)], cells) for line, cells in zip(grid, own)]


TABLES = "file string, table_no int, prefix string, rows array<struct<row:int,grid:array<string>,cells:array<struct<text:string,start:int,stop:int,down:int>>>>"


def whole_tables(files: DataFrame, key: str, text: str) -> DataFrame:
    """Every table with rows in the files' texts as one row, as TABLES: its rows with their spans, and as prefix what stands
    between it and the table before. Null texts and texts without tables give no rows; a null key stays null."""

    def run(batches):
        import pyarrow as pa

        def tables(batch):
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                end = 0
                for n, m in enumerate(re.finditer(r"(?is)<table\b.*?</table>", content or "")):
                    if rows := placed(m[0]):
                        yield file, n, content[end : m.start()], rows
                    end = m.end()

        def listed(lists, made):
            return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), made([x for one in lists for x in one]))

        def structs(kinds):
            return lambda told: pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(zip(*told) if told else [()] * len(kinds), kinds.values())], names=list(kinds))

        cells = structs({"text": pa.string(), "start": pa.int32(), "stop": pa.int32(), "down": pa.int32()})

        def rows(told):
            parts = [pa.array([r for r, _ in told], pa.int32()), listed([x[0] for _, x in told], lambda texts: pa.array(texts, pa.string())), listed([x[1] for _, x in told], cells)]
            return pa.StructArray.from_arrays(parts, names=["row", "grid", "cells"])

        def made(held):
            plain = zip(list(zip(*held))[:3], (pa.string(), pa.int32(), pa.string()))
            return pa.record_batch([*[pa.array(c, k) for c, k in plain], listed([list(enumerate(h[3])) for h in held], rows)], names=["file", "table_no", "prefix", "rows"])

        for b in batches:
            held, n = [], 0
            for one in tables(b):
                held.append(one)
                n += len(one[3])
                if n >= 4096:
                    yield made(held)
                    held, n = [], 0
            if held:
                yield made(held)

    return files.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, TABLES)


def table_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of whole_tables: (file, table_no, row, prefix, grid, cells), with the prefix in a table's first row only."""
    rows = whole_tables(files, key, text).select("file", "table_no", "prefix", F.inline_outer("rows"))
    return rows.select("file", "table_no", "row", F.when(F.col("row") == 0, F.col("prefix")).alias("prefix"), "grid", "cells")


CODE = r"^[A-Z]{1,3}\d{3,5}(-\d+)?$"


def code_rows(cells: DataFrame, continued: bool = False) -> DataFrame:
    """The first row of each table that holds item codes: one with a heading for codes and one code or more, or with
    two codes, or with one in a table that continues another."""
    text = F.col("text")
    rows = cells.groupBy("key", "table_no", "row").agg(F.count_if(text.rlike(CODE)).alias("codes"), F.bool_or(text.rlike("编号|编码|项目号")).alias("headed"))
    good = (F.col("headed") & (F.col("codes") >= 1)) | (F.col("codes") >= (1 if continued else 2))
    return rows.where(good).groupBy("key", "table_no").agg(F.min("row").alias("code_row"))


def quota_items(cells: DataFrame) -> DataFrame:
    """(key, table_no, code, category, name, unit, price, quantity): a table's resource lines for each of its items.

    Columns of the code row that hold codes are items; below it, a row's filled cell in an item's column is the
    quantity, and the cells before the first item are category, name, unit and price, from the left. The row of
    base prices has no unit.
    """
    first = code_rows(cells)
    marked = cells.join(first, ["key", "table_no"])
    items = marked.where((F.col("row") == F.col("code_row")) & F.col("text").rlike(CODE)).select("key", "table_no", F.col("col").alias("item_col"), F.col("text").alias("code"))
    left = items.groupBy("key", "table_no").agg(F.min("item_col").alias("first_col"))
    below = marked.where(F.col("row") > F.col("code_row")).join(left, ["key", "table_no"])
    lines = below.where(F.col("col") < F.col("first_col")).groupBy("key", "table_no", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    number = lambda c: F.regexp_extract(F.translate(c, ", ", ""), r"^\(?(-?\d+(?:\.\d+)?)\)?$", 1).try_cast("double")
    values = below.join(items, (below["key"] == items["key"]) & (below["table_no"] == items["table_no"]) & (below["col"] == items["item_col"])).select(below["key"], below["table_no"], "row", "code", number(F.col("text")).alias("quantity")).where("quantity IS NOT NULL")
    out = values.join(lines, ["key", "table_no", "row"], "left")
    return out.select("key", "table_no", "row", "code", F.col("m")[0].alias("category"), F.col("m")[1].alias("name"), F.col("m")[2].alias("unit"), number(F.col("m")[3]).alias("price"), "quantity")
