"""Checks of extracted prices and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_or_null, plain_number


def price_check(items: DataFrame, lines: DataFrame, tolerance: float = 0.05, appendix: DataFrame | None = None) -> DataFrame:
    """(code, base_price, expected, issue) for items (code, base_price) against lines (code, quantity, price, and name for an
    appendix): the sum of quantity x price must be the base price within the tolerance.

    A line without a price takes that of its name in the appendix (name, price), which has each name once; items without a
    base price, or with a line that stays unpriced, are skipped. A missing quantity counts as 0, and an item without lines
    is expected to cost nothing.
    """
    if appendix is not None:
        lines = lines.join(appendix.select("name", F.col("price").alias("listed")), "name", "left").withColumn("price", F.coalesce("price", "listed"))
    sums = lines.groupBy("code").agg(F.sum(F.coalesce("quantity", F.lit(0.0)) * F.col("price")).alias("sum"), F.count_if(F.col("price").isNull()).alias("unpriced"))
    expected = F.coalesce("sum", F.lit(0.0))
    skipped = F.col("base_price").isNull() | (F.coalesce("unpriced", F.lit(0)) > 0)
    issue = F.when(skipped, "skipped").when(F.abs(F.col("base_price") - expected) > tolerance, "BASE_PRICE_MISMATCH").otherwise("ok")
    return items.join(sums, "code", "left").select("code", "base_price", F.when(F.col("unpriced").isNull() | (F.col("unpriced") == 0), expected).alias("expected"), issue.alias("issue"))


def qa_issues(items: DataFrame, lines: DataFrame, tolerance: float = 0.05, appendix: DataFrame | None = None) -> DataFrame:
    """(code, level, issue) of items (code, name, unit, base_price) and their lines: prices that don't add up, codes left out
    of a sequence, missing units and names, and a base price without any line."""
    from ..operators.sequences import sequence_gaps

    off = price_check(items, lines, tolerance, appendix).where("issue = 'BASE_PRICE_MISMATCH'").select("code", F.lit("error").alias("level"), "issue")
    gaps = sequence_gaps(items, "code").select(F.col("missing").alias("code"), F.lit("warning").alias("level"), F.lit("CODE_GAP").alias("issue"))
    held = lines.select("code", F.lit(True).alias("held")).distinct()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = lambda test, level, name: F.when(test, F.struct(F.lit(level).alias("level"), F.lit(name).alias("issue")))
    rules = F.array_compact(F.array(found(blank("unit"), "warning", "MISSING_UNIT"), found(F.col("base_price").isNotNull() & F.col("held").isNull(), "warning", "EMPTY_RESOURCES"), found(blank("name"), "error", "MISSING_NAME")))
    shape = items.join(held, "code", "left").select("code", F.explode(rules).alias("r")).select("code", "r.level", "r.issue")
    return off.unionByName(gaps).unionByName(shape)


def qa_summary(items: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: items, those passed and failed, warnings, the pass rate, and issues by kind. Two errors of an item count
    twice, as each is one issue; without items everything passes."""
    total = items.agg(F.count("*").alias("total"))
    of = lambda name: F.count_if(F.col("issue") == name)
    errors = issues.agg(F.count_if(F.col("level") == "error").alias("failed"), F.count_if(F.col("level") == "warning").alias("warnings"), of("BASE_PRICE_MISMATCH").alias("price_failed"), of("CODE_GAP").alias("gaps"), F.count_if(~F.col("issue").isin("BASE_PRICE_MISMATCH", "CODE_GAP")).alias("structural"))
    passed = F.when(F.col("total") > 0, F.col("total") - F.col("failed")).otherwise(0)
    rate = F.when(F.col("total") > 0, F.round(passed / F.col("total"), 4)).otherwise(1.0)
    return total.crossJoin(errors).select("total", passed.alias("passed"), "failed", "warnings", rate.alias("pass_rate"), "price_failed", "gaps", "structural")


def line_values(lines: DataFrame) -> DataFrame:
    """Each line's value: quantity x price; the quantity itself where there is no price; a share of the basis for percentages."""
    value = F.when(F.col("unit") == "%", F.col("basis") * F.col("quantity") / 100).when(F.coalesce("price", F.lit(0.0)) == 0, F.col("quantity")).otherwise(F.col("quantity") * F.col("price"))
    return lines.withColumn("value", value)


def verification(lines: DataFrame) -> DataFrame:
    """(code, verified): the sum of an item's line values as it is printed; shares of other lines and appendices don't count."""
    kept = line_values(lines).where("NOT coalesce(excluded, false)")
    return kept.groupBy("code").agg(plain_number(F.sum("value")).alias("verified"))


# Names of steel goods, and of goods that only sound like them.
STEEL, NOT_STEEL = "螺纹钢|盘条|圆钢|型钢|钢筋", "塑钢|不锈钢"


def price_risks(rows: DataFrame) -> DataFrame:
    """(row_no, risk) for every rule that a row (row_no, name, unit, price, price_with_tax) breaks; the price with
    tax is the one that is judged."""
    net, gross = number_or_null(F.col("price")), number_or_null(F.col("price_with_tax"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(blank("unit"), "no_unit"), F.when(blank("price_with_tax"), "no_price"), F.when(gross <= 0, "not_positive"),
        F.when(F.col("name").rlike(STEEL) & ~F.col("name").rlike(NOT_STEEL) & (gross < 1000), "steel_too_cheap"), F.when((net != 0) & (gross < net), "tax_below_net"),
    ))
    return rows.select("row_no", F.explode(rules).alias("risk"))


def five_numbers(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Least, quartiles and greatest of a value by key."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = rows.groupBy(*key).agg(F.min(value).alias("low"), p.alias("p"), F.max(value).alias("high"))
    return out.select(*key, "low", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"), "high")


#: Places and known prices that may be paired: districts of a city times its materials.
PAIRS = 50_000_000


def interpolated(known: DataFrame, wanted: DataFrame, least: int = 3, power: float = 2.0) -> DataFrame:
    """Prices at wanted places (place, lat, lon) from known ones (material, lat, lon, price), weighted by the inverse
    distance to a power; none from fewer than `least`. Every known price bears on every place, so both have to be
    dimensions: more than PAIRS pairs raise."""
    if wanted.count() * known.count() > PAIRS:
        raise ValueError("interpolation is for the districts of a city; give fewer places or prices at a time")
    rad = lambda c: F.radians(F.col(c))
    pairs = wanted.crossJoin(known.select("material", F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon"), "price"))
    h = F.pow(F.sin((rad("k_lat") - rad("lat")) / 2), 2) + F.cos(rad("lat")) * F.cos(rad("k_lat")) * F.pow(F.sin((rad("k_lon") - rad("lon")) / 2), 2)
    weight = 1 / F.pow(F.greatest(2 * 6371 * F.asin(F.sqrt(h)), F.lit(1e-6)), power)
    return pairs.withColumn("w", weight).groupBy("place", "material").agg((F.sum(F.col("w") * F.col("price")) / F.sum("w")).alias("price"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def period_changes(rows: DataFrame, key: list[str], period: str, value: str) -> DataFrame:
    """Each key's mean value by period, with the period before that has one and the change from it in per cent."""
    from pyspark.sql import Window

    means = rows.groupBy(*key, period).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*key).orderBy(period)
    out = means.withColumn("before", F.lag(period).over(w)).withColumn("mean_before", F.lag("mean").over(w))
    return out.withColumn("change_pct", F.when(F.col("mean_before") != 0, (F.col("mean") / F.col("mean_before") - 1) * 100)).drop("mean_before")
