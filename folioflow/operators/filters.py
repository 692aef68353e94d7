"""Predicates, pages and counts of catalogue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(column: Column) -> Column:
    """Null or empty text."""
    return F.coalesce(column, F.lit("")) == ""


def truly(flag: Column) -> Column:
    """IS TRUE: a null flag isn't."""
    return F.coalesce(flag, F.lit(False))


def none_of(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is filled and none of the values."""
    return rows.where(~F.col(column).isin(*values)) if values else rows.where(F.col(column).isNotNull())


def of_province(rows: DataFrame, column: str, province: str | None) -> DataFrame:
    """Rows of a province by the first two digits of their region code; all rows without a province."""
    return rows.where(F.startswith(column, F.lit(province[:2]))) if province and len(province) >= 2 else rows


def chips(rows: DataFrame, dimensions: list[tuple[DataFrame, str]], wanted: dict[str, list]) -> DataFrame:
    """rows with the columns of their dimensions (frame, key); only those whose columns hold one of the wanted values. Without
    a wish about a dimension, rows that lack it stay."""
    for frame, key in dimensions:
        rows = rows.join(frame, key, "left")
    for column, values in wanted.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def having(rows: DataFrame, key: str, others: DataFrame, other_key: str | None = None) -> DataFrame:
    """Rows that some row of others names; each once."""
    return rows.join(others.select(F.col(other_key or key).alias("__other")), F.col(key) == F.col("__other"), "left_semi")


def dangling(rows: DataFrame, key: str, holders: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that none of the holders (frame, key) names."""
    for frame, other in holders:
        rows = rows.join(frame.select(F.col(other).alias("__other")), F.col(key) == F.col("__other"), "left_anti")
    return rows


def child_counts(rows: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """rows with the number of their children of each kind: name to (frame, key), each counted before it is joined."""
    for name, (frame, other) in children.items():
        rows = rows.join(frame.groupBy(F.col(other).alias(key)).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def divisions(rows: DataFrame, level: str | None = None, parent: str | None = None, name: str | None = None, disabled: bool = False) -> DataFrame:
    """Administrative divisions (code, name, level, parent_code, enabled) of a level, of a parent or by part of their name."""
    if not disabled:
        rows = rows.where(truly(F.col("enabled")))
    if level:
        rows = rows.where(F.col("level") == level)
    if parent:
        rows = rows.where(F.col("parent_code") == parent)
    return rows.where(F.col("name").ilike(f"%{name}%")) if name else rows


def listed(rows: DataFrame, key: str, column: str, descending: bool = True, page: int = 1, size: int = 20) -> DataFrame:
    """A page of rows by a column, equals by the key, nulls last; a page below 1 is the first, a size lies between 1 and 200."""
    size = max(1, min(size, 200))
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return rows.orderBy(order, F.asc(key)).offset((max(page, 1) - 1) * size).limit(size)


def sampled(rows: DataFrame, key: str, n: int = 50, seed: int = 0) -> DataFrame:
    """n rows at random, the same for the same seed: those with the least MD5 of seed and key, which SQL has as well."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def capped(issues: DataFrame, kind: str, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` issues in order, the number of all by kind)."""
    return issues.orderBy(*order).limit(max(0, limit)), issues.groupBy(kind).agg(F.count("*").alias("n"))


def files_by_hash(rows: DataFrame, digest: str, id_col: str) -> DataFrame:
    """(digest, ids, n) of content that several files hold, the ids in order."""
    return rows.groupBy(digest).agg(F.array_sort(F.collect_list(id_col)).alias("ids"), F.count("*").alias("n")).where("n > 1")


def latest_of_newest(rows: DataFrame, group: list[str], created: str, scheduled: str, key: str, n: int = 20) -> DataFrame:
    """For each group the row with the latest schedule, or creation where it has none, among its n newest."""
    newest = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(created), F.desc(key)))).where(F.col("__r") <= n)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.coalesce(scheduled, created)), "__r"))
    return newest.withColumn("__l", last).where("__l = 1").drop("__r", "__l")


def preferred(rows: DataFrame, group: str, key: str, order: list[Column]) -> DataFrame:
    """rows with the key of their group's first row in the order, and `is_preferred`."""
    first = F.first(key).over(Window.partitionBy(group).orderBy(*order, F.asc(key)))
    return rows.withColumn("preferred", first).withColumn("is_preferred", F.col(key) == F.col("preferred"))


def ordered_union(*lists: Column) -> Column:
    """The distinct values of several lists, in order; null lists are empty."""
    whole = F.flatten(F.array_compact(F.array(*lists)))
    return F.array_sort(F.array_distinct(whole))


def upserted(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known with the rows of new put in by their keys: a filled value of new wins, an empty one changes nothing; `outcome` says
    created, updated or kept. Both have a key once."""
    values = [c for c in known.columns if c not in keys]
    a = known.select(*keys, F.struct(*values).alias("a"))
    b = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in values]).alias("b"))
    outcome = F.when(F.col("b").isNull(), "kept").when(F.col("a").isNull(), "created").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in values], outcome.alias("outcome"))
