"""Campaigns over publications: what a run finds against what is known, and how publications changed over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["campaign_id", "source_item_key"]
#: Statuses of an item whose files are in, so that other files on its page are a change to look at.
SETTLED = ("done", "duplicate")


def merged(items: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """items (campaign_id, source_item_key, title, detail_url, fingerprint, status, first_seen_at, last_seen_at) after a run
    that found (campaign_id, source_item_key, title, detail_url, fingerprint).

    What is new is discovered. What is known takes the title, address and fingerprint that were found, even null ones, and
    is `changed` if it was settled with another fingerprint; nothing is fetched again for it. What wasn't found stays as it
    was. A key found twice in a run counts once, by its least row; rows without a key are left out.
    """
    given = ["title", "detail_url", "fingerprint"]
    once = found.where("campaign_id IS NOT NULL AND source_item_key IS NOT NULL").groupBy(*ITEM).agg(F.min(F.struct(*given)).alias("now"))
    both = items.withColumn("known", F.lit(True)).join(once, ITEM, "full")
    seen, known = F.col("now").isNotNull(), F.coalesce("known", F.lit(False))
    other = seen & F.col("status").isin(*SETTLED) & ~F.col("fingerprint").eqNullSafe(F.col("now.fingerprint"))
    return both.select(
        *ITEM, *[F.when(seen, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in given],
        F.when(~known, "discovered").when(other, "changed").otherwise(F.col("status")).alias("status"),
        F.when(known, F.col("first_seen_at")).otherwise(now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def intervals(sightings: DataFrame, key: list[str], seen: str, fingerprint: str) -> DataFrame:
    """The states that each key went through: fingerprint, valid_from, valid_to (null for the newest), last_seen and in how
    many sightings. A fingerprint that comes back begins a new state; null is a fingerprint like others; sightings of one
    moment go by their fingerprint."""
    order = Window.partitionBy(*key).orderBy(seen, F.col(fingerprint).asc_nulls_first())
    mark = F.when(F.row_number().over(order) == 1, 1).when(~F.col(fingerprint).eqNullSafe(F.lag(fingerprint).over(order)), 1).otherwise(0)
    runs = sightings.withColumn("__new", mark).withColumn("__state", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    states = runs.groupBy(*key, "__state").agg(F.first(fingerprint).alias(fingerprint), F.min(seen).alias("valid_from"), F.max(seen).alias("last_seen"), F.count("*").alias("sightings"))
    after = F.lead("valid_from").over(Window.partitionBy(*key).orderBy("__state"))
    return states.select(*key, fingerprint, "valid_from", after.alias("valid_to"), "last_seen", "sightings")
