"""Readers and writers of files: CSV with line numbers, ZIP members, XLSX sheets, manifests."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] = ()) -> DataFrame:
    """Rows of CSV files with a header, as text, with file and _line_number (the first row after the header is 2).
    A mark at the head of a file is skipped; a missing required field raises when it is read.

    Each file is read whole by one task, so that lines can be numbered.
    """
    import csv

    schema = ", ".join([f"`{c}` string" for c in columns] + ["file string", "_line_number long"])

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = csv.DictReader(io.StringIO(data.decode("utf-8-sig"), newline=""))
                for row in reader:
                    for c in required:
                        if not (row.get(c) or "").strip():
                            raise ValueError(f"{path}:{reader.line_num}: {c} is empty")
                    rows.append([row.get(c) for c in columns] + [path, reader.line_num])
            cols = list(zip(*rows)) or [[] for _ in range(len(columns) + 2)]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols[:-1]] + [pa.array(cols[-1], pa.int64())], names=[*columns, "file", "_line_number"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, size, content) of the archives in a binaryFile frame, without folders and system files."""

    def expand(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        if m.is_dir() or m.filename.startswith("__MACOSX/") or m.filename.rpartition("/")[2] == ".DS_Store":
                            continue
                        yield pa.record_batch([pa.array([path]), pa.array([m.filename]), pa.array([m.file_size], pa.int64()), pa.array([z.read(m)], pa.binary())], names=["path", "member", "size", "content"])

    return files.select("path", "content").mapInArrow(expand, "path string, member string, size long, content binary")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes):
    """(sheet, row number, cells) of a workbook; cells are text or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = links[sheet.get(f"{_REL}id")].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            for i, row in enumerate(ElementTree.fromstring(z.read(target)).iter(f"{_NS}row"), 1):
                cells: list = []
                for k, c in enumerate(row.iter(f"{_NS}c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    cells += [None] * (at + 1 - len(cells))
                    v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                    if inline is not None:
                        cells[at] = "".join(t.text or "" for t in inline.iter(f"{_NS}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield sheet.get("name"), int(row.get("r") or i), cells


def read_xlsx(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells) of the workbooks in a binaryFile frame; a row per row of a sheet."""

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(path, *r) for r in sheet_rows(data)]
                for at in range(0, len(rows), 2000):
                    cols = zip(*rows[at : at + 2000])
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())))], names=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInArrow(parse, "path string, sheet string, row_no long, cells array<string>")


# What names the column of materials, notes below a table, and the price without tax.
NAME_HEADS, NOTE_STARTS, NET_HEADS = ("材料名称", "产品名称", "设备名称", "设备材料名称"), ("备注", "注：", "注:"), ("不含税", "除税")


def price_sheet(rows: DataFrame, scan: int = 80, width: int = 50) -> DataFrame:
    """Price rows of read_xlsx: the first of a sheet's first `scan` rows that names material, unit and a price in its first
    `width` cells is the header; rows without a name, notes, and rows without unit and price are left out. A head that
    speaks of a price without tax is never the price with tax; of several columns that fit, the first counts."""
    from pyspark.sql import Window

    head = F.transform(F.slice("cells", 1, width), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    holds = lambda c, *words: c.rlike("|".join(words))
    at = lambda test: F.array_position(F.transform(head, test), True)
    columns = {
        "sequence": at(lambda c: holds(c, "序号")), "code": at(lambda c: holds(c, "代号", "编码")), "name": at(lambda c: holds(c, *NAME_HEADS)),
        "spec": at(lambda c: holds(c, "规格") & ~holds(c, *NAME_HEADS)), "unit": at(lambda c: holds(c, "单位")),
        "price": at(lambda c: holds(c, *NET_HEADS)), "price_with_tax": at(lambda c: holds(c, "含税") & ~holds(c, *NET_HEADS)),
    }
    found = rows.where(F.col("row_no") <= scan).select("path", "sheet", "row_no", *[c.alias(f"at_{n}") for n, c in columns.items()]).where("at_name > 0 AND at_unit > 0 AND (at_price > 0 OR at_price_with_tax > 0)")
    first = F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row_no"))
    found = found.withColumn("__r", first).where("__r = 1").drop("__r").withColumnRenamed("row_no", "head")
    cell = lambda n: F.trim(F.coalesce(F.try_element_at("cells", F.when(F.col(f"at_{n}") > 0, F.col(f"at_{n}").cast("int"))), F.lit("")))
    out = rows.join(found, ["path", "sheet"]).where("row_no > head").select("path", "sheet", "row_no", *[cell(n).alias(n) for n in columns])
    noted = F.lit(False)
    for start in NOTE_STARTS:
        noted = noted | F.startswith("name", F.lit(start))
    return out.where((F.col("name") != "") & ~noted & ~((F.col("unit") == "") & (F.col("price") == "") & (F.col("price_with_tax") == "")))


def write_xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of rows of text and numbers, for reports that fit the driver."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None or v == "":
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def export_manifest(rows: DataFrame, path: str, fields: list[str], form: str) -> None:
    """Write the fields, in their order, as CSV with a header or as JSON lines; any other form raises."""
    kept = rows.select(*fields)
    if form == "csv":
        kept.write.option("header", True).csv(path)
    elif form == "jsonl":
        kept.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no such form: {form}")
