"""Archives: how new ones are written, what rebuilds them, what an acceptance package holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_key
from ..operators.joins import cascade

# Labels of coverage states.
STATE_LABELS = {"covered": "已覆盖", "pending_verify": "待核", "missing": "缺失"}


def state_label(business: Column, sources: Column) -> Column:
    """What a coverage cell is called."""
    names = F.create_map(*[F.lit(x) for kv in STATE_LABELS.items() for x in kv])
    return F.when(business == "covered", names[business]).when(sources == "source_blocked", "源受阻").otherwise(F.coalesce(names[business], F.nullif(business, F.lit("")), F.lit("-")))


def cell_kind(business: Column, sources: Column, url: Column) -> Column:
    """How a coverage cell is drawn."""
    return F.when(business == "covered", F.when(url.isNotNull(), "file").otherwise("covered")).when(sources == "source_blocked", "blocked").when(business == "pending_verify", "pending").when(business == "missing", "missing").otherwise("empty")


def written(known: DataFrame, new: DataFrame) -> DataFrame:
    """new archives (event_id, tenant_code, domain_type, business_key, at) with their outcome against those known (tenant_code,
    domain_type, business_key), and those before them in the batch by (at, event_id): `created`, or for a key that is taken `attached`
    in cost_info, where the file joins the archive, and `rejected` elsewhere."""
    key = ["tenant_code", "domain_type", "business_key"]
    taken = known.select(*key).distinct().withColumn("taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("at", "event_id")) == 1
    out = new.withColumn("first", first).join(taken, key, "left")
    outcome = F.when(F.col("first") & F.col("taken").isNull(), "created").when(F.col("domain_type") == "cost_info", "attached").otherwise("rejected")
    return out.select("event_id", *key, outcome.alias("outcome"))


def source_match(rows: DataFrame, sources: DataFrame, legacy: str = "legacy") -> DataFrame:
    """rows (region_code, source_name) with a source_id and how it was found: by region, by province (a source of the province's
    own scope first), by name, or the legacy one. sources: source_id, seq (their order), region_code, name, publisher_scope."""
    prefix = F.substring("region_code", 1, 2)
    filled = sources.where(F.coalesce("region_code", F.lit("")) != "")
    by_region = filled.groupBy("region_code").agg(F.min_by("source_id", "seq").alias("source_id"))
    rank = F.struct(F.coalesce(F.col("publisher_scope") != "province", F.lit(True)), F.col("seq"))
    by_province = filled.groupBy(prefix.alias("prefix")).agg(F.min_by("source_id", rank).alias("source_id"))
    by_name = sources.where(F.coalesce("name", F.lit("")) != "").groupBy(F.col("name").alias("source_name")).agg(F.min_by("source_id", "seq").alias("source_id"))
    asked = rows.withColumn("prefix", F.when(F.coalesce("region_code", F.lit("")) != "", prefix))
    out = cascade(asked, [("region", ["region_code"], by_region), ("province", ["prefix"], by_province), ("name", ["source_name"], by_name)], "source_id")
    return out.drop("prefix").withColumn("match_kind", F.when(F.col("source_id").isNull(), "legacy").otherwise(F.col("match_kind"))).withColumn("source_id", F.coalesce("source_id", F.lit(legacy)))


def rebuild_plan(manifest: DataFrame, sources: DataFrame, known: DataFrame, mounted: DataFrame) -> DataFrame:
    """(sha256, source_id, match_kind, outcome) for the cost_info rows of a parse manifest: `incomplete`, `cross_source_duplicate`,
    `existing`, or `archive`, the first that holds.

    manifest: sha256, object_key, domain_types, parse_ready, archive_titles, period_raws, period_starts, original_names, region_codes,
    source_urls, source_names, as texts of values in order; known: source_id, region_code, period, title, source_url, sha256 of
    valid archives; mounted: sha256 of files that an archive has. A duplicate is an archive of another source with the same
    region, period and title that has the url or the content.
    """
    first = lambda c: F.nullif(F.trim(F.substring_index(F.col(c), " | ", 1)), F.lit(""))
    rows = manifest.where(first("domain_types") == "cost_info").select(
        "sha256", F.coalesce(first("archive_titles"), first("period_raws"), first("original_names"), F.col("sha256")).alias("title"), first("region_codes").alias("region_code"), F.coalesce(first("period_starts"), first("period_raws")).alias("period"),
        first("source_names").alias("source_name"), first("source_urls").alias("source_url"), ((F.trim("parse_ready") == "true") & (F.coalesce("sha256", F.lit("")) != "") & (F.coalesce("object_key", F.lit("")) != "")).alias("ready"),
    )
    rows = rows.withColumn("ready", F.coalesce("ready", F.lit(False)) & F.col("region_code").isNotNull() & F.col("period").isNotNull())
    matched = source_match(rows, sources)
    key = ["region_code", "period", "title"]
    # A proof is one row for its key: another source has it if the least or the greatest of its sources is another one.
    proof = lambda frame, by: frame.groupBy(*key, by).agg(F.min("source_id").alias("least"), F.max("source_id").alias("most"))
    foreign = (F.col("source_id") != F.col("least")) | (F.col("source_id") != F.col("most"))
    probe = matched.where("ready").select("sha256", "source_id", *key, "source_url")
    # A url is normalised once, however many rows have it: what an explode makes can't be worked out again below the distinct.
    urls = rows.select("source_url").union(known.select("source_url")).distinct().select("source_url", F.explode_outer(F.array(url_key(F.col("source_url")))).alias("url"))
    same_url = probe.join(urls, "source_url").join(proof(known.select(*key, "source_id", "source_url").distinct().join(urls, "source_url"), "url"), [*key, "url"]).where(foreign).select("sha256")
    same_file = probe.join(proof(known, "sha256"), [*key, "sha256"]).where(foreign).select("sha256")
    doubled = same_url.union(same_file).distinct().withColumn("doubled", F.lit(True))
    held = mounted.select("sha256").distinct().withColumn("held", F.lit(True))
    out = matched.join(doubled, "sha256", "left").join(held, "sha256", "left")
    outcome = F.when(~F.col("ready"), "incomplete").when(F.col("doubled"), "cross_source_duplicate").when(F.col("held"), "existing").otherwise("archive")
    return out.select("sha256", F.when(F.col("ready"), F.col("source_id")).alias("source_id"), F.when(F.col("ready"), F.col("match_kind")).alias("match_kind"), outcome.alias("outcome"))


def pending_fetches(files: DataFrame, limit: int = 10, scan: int = 500, include_failed: bool = False) -> DataFrame:
    """Files (archive_file_id, domain_type, fetch_status, publish_date, created_at, sort_order, failed) that wait for their attachment,
    the earliest published first, with `outcome`: fetch, or skipped_failed. Of the first `scan` (1000 at most) the first
    `limit` (100 at most) that haven't failed are fetched, and the failures before the last of them are told."""
    limit = max(1, min(limit, 100))
    scan = max(limit, min(max(1, scan), 1000))
    order = [F.asc_nulls_last("publish_date"), F.asc("created_at"), F.asc("sort_order"), F.asc("archive_file_id")]
    seen = files.where("domain_type = 'trading' AND fetch_status = 'pending'").orderBy(*order).limit(scan)
    fails = F.lit(False) if include_failed else F.coalesce("failed", F.lit(False))
    # At most a thousand rows are left.
    before = F.sum(F.when(fails, 0).otherwise(1)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = seen.withColumn("failed", fails).withColumn("turn", before)
    kept = out.where((~F.col("failed") & (F.col("turn") <= limit)) | (F.col("failed") & (F.col("turn") < limit)))
    return kept.select("archive_file_id", F.when(F.col("failed"), "skipped_failed").otherwise("fetch").alias("outcome"))


def counted(rows: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """(section, measure, value, n): all rows, and how many have each value of each column; one pass, blank values left out."""
    kinds = F.array(F.struct(F.lit("total").alias("measure"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in columns])
    found = rows.select(F.explode(kinds).alias("k")).where("k.measure = 'total' OR coalesce(k.value, '') <> ''")
    return found.groupBy("k.measure", "k.value").agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "measure", "value", "n")


def acceptance_summary(sources: DataFrame, archives: DataFrame, cells: DataFrame, tasks: DataFrame) -> DataFrame:
    """The counts of an acceptance package: sources by audit_status, archives by channel_type and status, cells by both
    statuses, tasks by status."""
    parts = (counted(sources, "sources", ["audit_status"]), counted(archives, "archives", ["channel_type", "status"]), counted(cells, "coverage", ["business_coverage_status", "source_completeness_status"]), counted(tasks, "tasks", ["status"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_package(path: str, tables: dict[str, DataFrame], reports: dict[str, DataFrame]) -> None:
    """An acceptance package below path: each table as CSV with a header, each report as JSON lines."""
    for name, rows in tables.items():
        rows.write.option("header", True).csv(f"{path}/{name}")
    for name, rows in reports.items():
        rows.write.option("ignoreNullFields", False).json(f"{path}/{name}")


def quota_stats(sets: DataFrame, archives: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: publication sets, archives, distinct files (file_id), and candidates by projection_status."""
    state = lambda x: F.count_if(F.col("projection_status") == x).alias(x)
    one = sets.agg(F.count("*").alias("systems")).crossJoin(archives.agg(F.count("*").alias("archived"))).crossJoin(files.agg(F.count_distinct("file_id").alias("raw_total")))
    return one.crossJoin(candidates.agg(*[state(x) for x in ("pending", "linked", "duplicate", "invalid", "ignored")]))


def same_url(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (id, other_id) of rows and others (tenant_code, id, source_url) of a tenant whose urls are the same when normalised."""
    keyed = lambda df, name: df.select("tenant_code", F.col("id").alias(name), url_key(F.col("source_url")).alias("url")).where("url IS NOT NULL")
    return keyed(rows, "id").join(keyed(others, "other_id"), ["tenant_code", "url"]).select("id", "other_id").distinct()


def siblings(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """(id, others): for each row the ids of the other rows of its group, in order. Groups are the volumes of one edition."""
    members = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(id_col)).alias("__all"))
    return rows.join(members, group).select(F.col(id_col).alias("id"), F.array_remove("__all", F.col(id_col)).alias("others"))


def mirror_path(domain: Column, province: Column, city: Column, year: Column, title: Column, role: Column, name: Column, direct: tuple = ("original", "source", "primary")) -> Column:
    """Where a file is mirrored: domain/province/city/year/file, with the archive's title above and the role before the name
    unless the role is a direct one."""
    safe = lambda c, n=180: F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(".."), F.lit("_")), "_+", "_"), r"^[ .]+|[ .]+$", ""), 1, n), F.lit("")), F.lit("_"))
    file = safe(name)
    return F.when(role.isin(*direct), F.concat_ws("/", safe(domain), safe(province), safe(city), safe(year), file)).otherwise(F.concat_ws("/", safe(domain), safe(province), safe(city), safe(year), safe(title), F.concat(safe(role, 48), F.lit("-"), file)))


def mirror_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, mirror_status) of expected files (path, size) against those found (path, size): mirrored, stale or missing."""
    out = expected.join(found.select("path", F.col("size").alias("found")), "path", "left")
    return out.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.coalesce("size", F.lit(0)), "mirrored").otherwise("stale").alias("mirror_status"))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A report's table as markdown, for the first `most` rows; the driver formats no more than that."""
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    for r in rows.limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |")
    return "\n".join(lines)
