"""Comparison of norm books across provinces by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.catalog import first_per
from ..operators.sequences import item_blocks

# The kinds of rows that are a section and an item.
SECTION, ITEM = "段", "定"


def item_hits(rows: DataFrame, matches: Column, level: Column, depth: int = 4) -> DataFrame:
    """Blocks of the items that match, by province: the item's row and its lines up to the next item or section.

    rows: province, row_no, kind, code, name and more; matches is a predicate on an item's columns, level a section
    row's depth. Of items that repeat a code in a province, the first counts. Sections above an item come as
    section_1 to section_<depth>; new_section tells where they differ from the block before.
    """
    cut = item_blocks(rows, "province", "row_no", "kind", SECTION, ITEM, level, depth)
    items = first_per(cut.where((F.col("kind") == ITEM) & F.coalesce(matches, F.lit(False))), ["province", "code"], ["row_no"])
    titles = F.struct(*[f"section_{d}" for d in range(1, depth + 1)])
    w = Window.partitionBy("province").orderBy("row_no")
    marked = items.withColumn("new_section", (F.row_number().over(w) == 1) | ~titles.eqNullSafe(F.lag(titles).over(w)))
    wanted = marked.select("province", "block", F.col("row_no").alias("item_row"), "new_section", *[F.col(f"section_{d}").alias(f"__t{d}") for d in range(1, depth + 1)])
    # A section ends a block even where no item follows.
    ends = cut.where(F.col("kind") == SECTION).groupBy("province", "block").agg(F.min("row_no").alias("__end"))
    lines = cut.where(F.col("kind") != SECTION).join(ends, ["province", "block"], "left").where("__end IS NULL OR row_no < __end").drop("__end", *[f"section_{d}" for d in range(1, depth + 1)])
    out = lines.join(wanted, ["province", "block"]).withColumn("new_section", F.col("new_section") & (F.col("row_no") == F.col("item_row")))
    return out.drop("item_row").withColumnsRenamed({f"__t{d}": f"section_{d}" for d in range(1, depth + 1)})


def province_counts(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == ITEM).groupBy("province").agg(F.count("*").alias("n"))


def sheet_rows(hits: DataFrame, columns: list[str], depth: int = 4) -> DataFrame:
    """Rows as a report prints them, with an order key: a province's banner, a section's titles where they change, then
    the block's lines. The frame is sorted; a report that fits the driver writes it with write_xlsx."""
    cells = lambda *c: F.array(*[x.cast("string") for x in c])
    first = hits.groupBy("province").agg(F.min("row_no").alias("row_no"))
    banner = first.select("province", "row_no", F.lit(0).alias("part"), F.lit(0).alias("depth"), cells(F.col("province")).alias("cells"))
    heads = hits.where("new_section").select("province", "row_no", F.lit(1).alias("part"), F.posexplode(F.array(*[f"section_{d}" for d in range(1, depth + 1)])).alias("depth", "title")).where("title IS NOT NULL")
    heads = heads.select("province", "row_no", "part", "depth", cells(F.col("title")).alias("cells"))
    lines = hits.select("province", "row_no", F.lit(2).alias("part"), F.lit(0).alias("depth"), cells(*[F.col(c) for c in columns]).alias("cells"))
    return banner.unionByName(heads).unionByName(lines).orderBy("province", "row_no", "part", "depth")
