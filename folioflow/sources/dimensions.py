"""Dimensions out of CSV files, JSON payloads, object listings and norm workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import read_csv

# Levels of target regions, what they need to say, and what counts as yes.
TARGET_LEVELS = ("province", "prefecture", "municipality", "county", "subregion", "city")
REQUIRED = ("admin_division_version", "province_code", "province_name", "target_region_code", "target_region_name")
YES = ("1", "true", "yes", "y", "是")


def _clean(column: str):
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def national_regions(spark: SparkSession, path: str, levels: tuple = TARGET_LEVELS) -> DataFrame:
    """Target regions of a CSV file; a row with an unknown level, or without a required field, fails the job and names its line."""
    fields = [*REQUIRED, "target_level", "is_required", "source_note"]
    rows = read_csv(spark, path, fields)
    line = F.col("_line_number").cast("string")
    missing = F.array_join(F.array_compact(F.array(*[F.when(_clean(c).isNull(), c) for c in REQUIRED])), ",")
    wrong = F.when(~F.coalesce(_clean("target_level").isin(*levels), F.lit(False)), F.concat(F.lit("INVALID_TARGET_LEVEL line="), line)).when(missing != "", F.concat(F.lit("NATIONAL_REGION_REQUIRED_FIELD_MISSING line="), line, F.lit(": "), missing))
    # The check is part of a column that every reader wants, so no reader can leave it out.
    code = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(_clean("target_region_code"))
    required = F.coalesce(F.lower(F.trim("is_required")).isin(*YES), F.lit(False))
    return rows.select(*[code.alias(c) if c == "target_region_code" else required.alias(c) if c == "is_required" else _clean(c).alias(c) for c in fields])


def repeated_targets(regions: DataFrame) -> DataFrame:
    """Required region codes that stand on several lines."""
    return regions.where("is_required").groupBy("target_region_code").agg(F.count("*").alias("n")).where("n > 1")


def region_levels(regions: DataFrame) -> DataFrame:
    """(province_code, province_name, required_targets, levels): required targets of each province, and how many of each level."""
    counts = regions.where("is_required").groupBy("province_code", "target_level").agg(F.count("*").alias("n"), F.min("province_name").alias("name"))
    return counts.groupBy("province_code").agg(F.min("name").alias("province_name"), F.sum("n").alias("required_targets"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("target_level", "n")))).alias("levels"))


def region_map(spark: SparkSession, path: str) -> DataFrame:
    """(region_code, province_name, region_name) of a CSV file; the last line of a code counts, and lines without a name don't."""
    rows = read_csv(spark, path, ["target_region_code", "province_name", "target_region_name"])
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = rows.select(text("target_region_code").alias("region_code"), text("province_name").alias("province_name"), text("target_region_name").alias("region_name"), "_line_number")
    named = rows.where("region_code <> '' AND (province_name <> '' OR region_name <> '')")
    return named.groupBy("region_code").agg(F.max_by(F.struct("province_name", "region_name"), "_line_number").alias("r")).select("region_code", "r.province_name", "r.region_name")


def payload_rows(spark: SparkSession, paths: list[str] | str, fields: list[str]) -> DataFrame:
    """(path, row_no, fields) of extracts in JSON files, one object with `rows` a file; a field that a row lacks is empty."""
    row = ", ".join(f"{f} string" for f in fields)
    struct = "array<struct<" + row.replace(" string", ":string") + ">>"
    files = spark.read.schema(f"rows {struct}").option("multiLine", True).json(paths).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode("rows").alias("row_no", "r")).select("path", "row_no", *[F.coalesce(f"r.{f}", F.lit("")).alias(f) for f in fields])


def listed_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(object_key, size, sha256, file_ext) of all files below a folder: keys from `objects/` on, digests from their layout
    objects/aa/bb/digest.ext, null where they lie otherwise. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    key = F.regexp_extract("path", r"(objects/.*)$", 1)
    digest = F.regexp_extract(key, r"^objects/([0-9a-f]{2})/([0-9a-f]{2})/(\1\2[0-9a-f]{60})(?:\.[^./]*)?$", 3)
    return found.select(F.when(key != "", key).otherwise(F.col("path")).alias("object_key"), F.col("length").alias("size"), F.nullif(digest, F.lit("")).alias("sha256"), F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)).alias("file_ext"))


def backfill_plan(objects: DataFrame, known: DataFrame) -> DataFrame:
    """objects with `outcome` against known (object_key): present, insert, or unreadable for a key without a digest."""
    marked = objects.join(known.select("object_key").distinct().withColumn("held", F.lit(True)), "object_key", "left")
    return marked.withColumn("outcome", F.when(F.col("held"), "present").when(F.col("sha256").isNull(), "unreadable").otherwise("insert")).drop("held")


def standard_rows(rows: DataFrame, sheet: str = "定额条目", width: int = 9) -> DataFrame:
    """(path, row_no, cells) of read_xlsx rows: those of the named sheet, else of the first by name, below the first row that has both
    项目编码 and 名称 (all rows without one), as `width` cells each."""
    first = rows.groupBy("path").agg(F.max(F.col("sheet") == sheet).alias("named"), F.min("sheet").alias("least"))
    own = rows.join(first, "path").where(F.col("sheet") == F.when(F.col("named"), sheet).otherwise(F.col("least")))
    is_head = F.array_contains("cells", "项目编码") & F.array_contains("cells", "名称")
    head = F.min(F.when(is_head, F.col("row_no"))).over(Window.partitionBy("path"))
    below = own.withColumn("head", head).where(F.col("head").isNull() | (F.col("row_no") > F.col("head")))
    return below.select("path", "row_no", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("cells", i)).alias("cells"))
