"""Listing, search, facets, first-per-group and counts over catalogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, equal: dict | None = None, **any_of) -> DataFrame:
    """Rows whose columns equal the given values (None: no condition) and are among the given lists."""
    for name, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    for name, values in any_of.items():
        if values is not None:
            rows = rows.where(F.col(name).isin(*values))
    return rows


def search(rows: DataFrame, text: str | None, columns: list[str], ignore_case: bool = False) -> DataFrame:
    """Rows in which every blank-separated token of text occurs in one of the columns; % and _ are wildcards."""
    for token in (text or "").split():
        like = [(F.col(c).ilike if ignore_case else F.col(c).like)(f"%{token}%") for c in columns]
        rows = rows.where(reduce(Column.__or__, like))
    return rows


def haystack(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks in lower case, contain text."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def keyword(name: Column, all_of: list[str], any_of: list[str] = (), none_of: list[str] = ()) -> Column:
    """Exclusions first, then every required word, then one of the alternatives; an empty name never matches."""
    ok = (F.coalesce(name, F.lit("")) != "") & ~reduce(Column.__or__, [F.contains(name, F.lit(w)) for w in none_of], F.lit(False))
    ok = reduce(Column.__and__, [F.contains(name, F.lit(w)) for w in all_of], ok)
    return F.coalesce(ok & reduce(Column.__or__, [F.contains(name, F.lit(w)) for w in any_of], F.lit(not any_of)), F.lit(False))


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of at most 500 rows; order must end in a key."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. order must end in a key, and says where nulls stand."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def seeded_counts(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts by value, with 0 for known values that don't occur; other values are counted too."""
    spark = rows.sparkSession
    found = rows.groupBy(column).agg(F.count("*").alias("n"))
    seed = spark.createDataFrame([(k,) for k in known], f"{column} string")
    return seed.unionByName(found.select(column)).distinct().join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def nested_facet(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner, with the outer total beside each."""
    by_both = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return by_both.withColumn("n_outer", F.sum("n").over(Window.partitionBy(outer)))


def labelled(counts: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """Counts with the label of their key, or the key itself where there is none."""
    return counts.join(labels, key, "left").withColumn(label, F.coalesce(label, F.col(key).cast("string")))


def dimension_index(rows: DataFrame, org: str, province: str, city: str, measures: list[Column]) -> DataFrame:
    """Measures for every scope of {all, org} x {all, province, province and city}. Rows without an org count for
    `all` alone, so no group of a null org comes out. Scopes are told by org_all and level."""
    sets = [(), (org,), (province,), (org, province), (province, city), (org, province, city)]
    cols = [org, province, city]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping(org).alias("org_all"), (2 - F.grouping(province) - F.grouping(city)).alias("level"), *measures)
    return grouped.where((F.col("org_all") == 1) | F.col(org).isNotNull())


def repeated(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Keys that occur at least so often, with their number: a broken uniqueness rule."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def consistent_status(counts: Column, failed: Column, running: Column, pending: Column) -> Column:
    """The status of a campaign from its items' counts."""
    return F.when(counts == 0, "empty").when(running + pending > 0, "running").when(failed == counts, "failed").when(failed > 0, "partial").otherwise("completed")


def representation_roles(mounts: DataFrame, key: str, order: list[Column], sheet: Column) -> DataFrame:
    """mounts with is_primary: every spreadsheet of a group that has one, else its first row. order must end in a key."""
    has = F.bool_or(sheet).over(Window.partitionBy(key))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return mounts.withColumn("is_primary", F.when(F.coalesce(has, F.lit(False)), F.coalesce(sheet, F.lit(False))).otherwise(first))


def ranked(rows: DataFrame, key: str, ranks: dict, last: int = 9999) -> DataFrame:
    """rows with the rank of their key; unknown keys come last."""
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return rows.withColumn("rank", F.coalesce(known[F.col(key)], F.lit(last)))
