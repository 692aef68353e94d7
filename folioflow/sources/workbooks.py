"""Standard workbooks of norm books, made by tasks, and ranges of stored bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sheet and the columns of a standard workbook.
SHEET = "定额条目"
HEADER = ("类型", "项目编码", "名称", "项目特征", "计量单位", "消耗量", "基价/单价", "验证", "标准换算", "标准换算来源")
#: Rows of one workbook; a longer book goes on in the next part.
ROWS = 100_000


def standard_rows(lines: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(file, at, cells): the rows of the standard workbook in their order: lines as plans.norm_tables gives them, a blank row
    behind each item, and sections (file, table_no, line_no, place, code, name) before the table that they stand above."""
    empty = F.lit("")
    at = lambda *parts: F.array(*[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("int") for p in parts]).alias("at")
    place = [F.get("place", F.lit(k)) for k in range(3)]
    item = lines.select("file", at("table_no", 1, "part", "item", "slot", *place), F.array("kind", "code", "name", "feature", "unit", "quantity", "price", "verify", empty, empty).alias("cells"))
    ends = lines.select("file", "table_no", "part", "item").distinct()
    blank = ends.select("file", at("table_no", 1, "part", "item", 99, 0, 0, 0), F.array(*[empty] * len(HEADER)).alias("cells"))
    out = item.unionByName(blank)
    if sections is not None:
        heads = sections.select("file", at("table_no", 0, "line_no", "place", 0, 0, 0, 0), F.array(F.lit("段"), "code", "name", *[empty] * 7).alias("cells"))
        out = out.unionByName(heads)
    return out


def workbooks(rows: DataFrame, header: tuple[str, ...] = HEADER, sheet: str = SHEET, limit: int = ROWS) -> DataFrame:
    """(file, part, n_rows, content): rows (file, at, cells) as workbooks of one sheet. A book's rows come sorted to one task,
    which writes a workbook each time `limit` rows are full, so it holds one part of one book; null cells are blank, rows of
    no file are left out, and no rows give no workbooks."""

    def run(batches):
        import pyarrow as pa

        from folioflow.sources.files import write_xlsx

        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_rows", pa.int64()), ("content", pa.binary())])
        file, part, held = None, 0, []

        def out():
            content = write_xlsx({sheet: [list(header), *held]})
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((file, part, len(held), content), schema)], schema=schema)

        for b in batches:
            for name, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (name != file or len(held) >= limit):
                    yield out()
                    part, held = part + 1 if name == file else 0, []
                file = name
                held.append(["" if c is None else c for c in cells])
        if held:
            yield out()

    ordered = rows.where("file IS NOT NULL").repartition("file").sortWithinPartitions("file", "at")
    return ordered.select("file", "cells").mapInArrow(run, "file string, part int, n_rows long, content binary")


def saved(books: DataFrame, folder: str) -> DataFrame:
    """(path, n_rows) of workbooks written below a folder that all tasks reach as a path. Each is written beside its place and
    then moved there, so a task that runs twice leaves one whole file."""

    def run(batches):
        import os
        import uuid

        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for file, part, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                path = f"{folder}/{re.sub(r'[^0-9A-Za-z一-龥._-]+', '_', file)}-{part}.xlsx"
                with open(made := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(made, path)
                paths.append(path)
            yield pa.record_batch([pa.array(paths, pa.string()), b.column(2)], names=["path", "n_rows"])

    return books.mapInArrow(run, "path string, n_rows long")


def byte_range(content: Column, wanted: Column) -> Column:
    """(start, stop, total, bytes) of what a range header asks for (bytes=a-b, bytes=a- or bytes=-n, both ends included), cut to
    the content; null if the header isn't one range, or nothing of the content lies in it."""
    size = F.octet_length(content).cast("long")
    first, last = (F.nullif(F.regexp_extract(wanted, r"^\s*bytes\s*=\s*(\d*)\s*-\s*(\d*)\s*$", k), F.lit("")).try_cast("long") for k in (1, 2))
    start = F.coalesce(first, F.greatest(size - last, F.lit(0)))
    stop = F.when(first.isNull(), size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    good = (first.isNotNull() | last.isNotNull()) & (start <= stop) & (start < size)
    cut = F.substring(content, (start + 1).cast("int"), (stop - start + 1).cast("int"))
    return F.when(good, F.struct(start.alias("start"), stop.alias("stop"), size.alias("total"), cut.alias("bytes")))
