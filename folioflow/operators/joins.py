"""Joins that catalogue work needs beyond a plain key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows that name a parent which isn't there."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("__parent")), F.col(key) == F.col("__parent"), "left_anti")


def conflicts(left: DataFrame, right: DataFrame, on: list[str], differ: list[tuple[str, str]]) -> DataFrame:
    """Pairs that agree on the keys and differ in one of the columns; a null differs from a value."""
    joined = left.join(right, on)
    test = F.lit(False)
    for a, b in differ:
        test = test | ~F.col(a).eqNullSafe(F.col(b))
    return joined.where(test)


def cascade(rows: DataFrame, steps: list[tuple[str, list[str], DataFrame]], value: str) -> DataFrame:
    """rows with `value` from the first step (kind, keys, lookup) that has one, and its kind; lookups hold a row
    for each key at most."""
    kinds, values = [], []
    for i, (kind, keys, lookup) in enumerate(steps):
        own = lookup.select(*keys, F.col(value).alias(f"__v{i}"))
        rows = rows.join(own, keys, "left")
        values.append(F.col(f"__v{i}"))
        kinds.append(F.when(F.col(f"__v{i}").isNotNull(), kind))
    out = rows.withColumn(value, F.coalesce(*values)).withColumn("match_kind", F.coalesce(*kinds, F.lit("none")))
    return out.drop(*[f"__v{i}" for i in range(len(steps))])


def first_filled(*columns: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def duplicates_across(rows: DataFrame, source: str, keys: list[str], proofs: list[str], id_col: str) -> DataFrame:
    """Pairs of ids from different sources that agree on all keys and on one proof. Each proof is an equi-join, so
    that neither side is ever paired by an OR."""
    out = None
    for proof in proofs:
        a = rows.select(*keys, proof, F.col(id_col).alias("a"), F.col(source).alias("sa"))
        b = rows.select(*keys, proof, F.col(id_col).alias("b"), F.col(source).alias("sb"))
        pairs = a.join(b, [*keys, proof]).where("sa <> sb AND a < b").select("a", "b")
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def aligned(resources: DataFrame, candidates: DataFrame, threshold: float = 0.92, others: bool = False) -> DataFrame:
    """Each resource (id, category, name, unit) with its best candidate (candidate_id, category, name, unit): score
    0.8 x name + 0.2 x unit similarity of the normalised texts, where different units count 0.5; the smallest id wins ties.
    others: a candidate of the same name isn't one.

    Every resource comes out, and every candidate of its category counts: one whose name shares no bigram has what the units
    give, 0.2 or 0.1, so it can beat a name that shares a few and has another unit. A null category is a category. Without a
    candidate there is none, and a score of 0. Names are compared once each, however many resources and candidates have
    them, and shared bigrams are counted, so what is joined is a row for each bigram that two names share.
    """
    from ..functions.text import bigrams, resource_name, resource_text

    plain = lambda c, f: f(F.coalesce(F.col(c), F.lit("")))
    grouped = F.when(F.col("category").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("category").cast("string"))).alias("category")
    left = resources.select("id", grouped, plain("name", resource_name).alias("name"), plain("unit", resource_text).alias("unit"))
    right = candidates.select("candidate_id", grouped, plain("name", resource_name).alias("c_name"), plain("unit", resource_text).alias("c_unit"))
    mine, theirs = left.select("category", "name").distinct(), right.select("category", "c_name").distinct()
    size = lambda c: F.size(bigrams(F.col(c)))
    shared = mine.select("category", "name", size("name").alias("n"), F.explode(bigrams(F.col("name"))).alias("gram")).join(
        theirs.select("category", "c_name", size("c_name").alias("m"), F.explode(bigrams(F.col("c_name"))).alias("gram")), ["category", "gram"]
    )
    alike = shared.groupBy("category", "name", "c_name").agg((F.count("*") / F.greatest(F.max("n"), F.max("m"))).alias("alike"))
    if others:
        alike = alike.where("name <> c_name")
    score = 0.8 * F.col("alike") + 0.2 * F.when(F.col("unit") == F.col("c_unit"), 1.0).otherwise(0.5)
    scored = left.select("category", "name", "unit").distinct().join(alike, ["category", "name"]).join(right, ["category", "c_name"]).withColumn("score", score)
    first = F.min(F.struct((-F.col("score")).alias("minus"), "candidate_id"))
    best = scored.groupBy("category", "name", "unit").agg(first.alias("best"))
    # What the units alone give: for each category and unit the first candidate, and the first of another name for it.
    def firsts(keys: list[str], prefix: str) -> DataFrame:
        first = right.groupBy(*keys).agg(F.min(F.struct(F.col("candidate_id").alias("id"), F.col("c_name").alias("name"))).alias(f"{prefix}1"))
        if not others:
            return first.withColumn(f"{prefix}2", F.lit(None).cast(first.schema[f"{prefix}1"].dataType))
        second = right.join(first, keys).where(F.col("c_name") != F.col(f"{prefix}1.name")).groupBy(*keys).agg(F.min(F.struct(F.col("candidate_id").alias("id"), F.col("c_name").alias("name"))).alias(f"{prefix}2"))
        return first.join(second, keys, "left")

    def taken(prefix: str) -> Column:
        return F.when((F.col(f"{prefix}1.name") != F.col("name")) | F.lit(not others), F.col(f"{prefix}1.id")).otherwise(F.col(f"{prefix}2.id"))

    of_unit = firsts(["category", "c_unit"], "same").withColumnRenamed("c_unit", "unit")
    out = left.join(best, ["category", "name", "unit"], "left").join(of_unit, ["category", "unit"], "left").join(firsts(["category"], "any"), "category", "left")
    pick = lambda minus, of: F.when(of.isNotNull(), F.struct(minus.alias("minus"), of.alias("candidate_id")))
    out = out.withColumn("pick", F.array_min(F.filter(F.array(pick(F.col("best.minus"), F.col("best.candidate_id")), pick(F.lit(-0.2), taken("same")), pick(F.lit(-0.1), taken("any"))), lambda x: x.isNotNull())))
    value = F.coalesce(-F.col("pick.minus"), F.lit(0.0))
    return out.select("id", F.col("pick.candidate_id").alias("candidate_id"), value.alias("score"), (value >= threshold).alias("matched"))


def full_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows differ or are on one side only."""
    a = left.select(key, F.struct(*columns).alias("l"))
    b = right.select(key, F.struct(*columns).alias("r"))
    return a.join(b, key, "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(key, F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("changed").alias("change"))


def by_hash_prefix(rows: DataFrame, digest: str, others: DataFrame, other: str, length: int = 12) -> DataFrame:
    """Pairs whose hex digests begin alike, whatever their case."""
    head = lambda c: F.substring(F.lower(c), 1, length)
    return rows.withColumn("__head", head(digest)).join(others.withColumn("__head", head(other)), "__head").drop("__head")
