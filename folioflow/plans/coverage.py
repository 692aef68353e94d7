"""Coverage of regions by months, and why cells are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import month_of, months_between, region_and_parent

# The stage in which a task failed, by its error code.
STAGE_OF_ERROR = {
    "DOWNLOAD_TIMEOUT": "download_timeout", "HOST_UNREACHABLE": "host_unreachable", "PARSE_ERROR": "parse_error",
    "COST_INFO_CRAWL_TASK_FAILED": "crawl_failed", "MAX_ATTEMPTS_EXCEEDED": "max_attempts_exceeded",
}
# Provinces that are cities, and the names of target levels.
MUNICIPALITIES = ("110000", "120000", "310000", "500000")
CITY_LEVELS, SUBREGION_LEVELS = ("city", "prefecture", "prefecture_city", "municipality"), ("subregion", "county", "district", "county_district")
#: What makes a gap worth an attempt.
ACTIONABLE = ("not_attempted", "failed")


def failed_stage(code: Column) -> Column:
    """The stage of an error code; null for others."""
    return F.create_map(*[F.lit(x) for kv in STAGE_OF_ERROR.items() for x in kv])[code]


def target_level(level: Column, region: Column) -> Column:
    """A target's level in one of its names; the province of a municipality is a city."""
    text = F.lower(F.trim(level))
    city = text.isin(*CITY_LEVELS) | ((text == "province") & F.coalesce(region, F.lit("")).isin(*MUNICIPALITIES))
    return F.when(city, "city").when(text.isin(*SUBREGION_LEVELS), "subregion").otherwise(F.nullif(text, F.lit("")))


def classified(cells: DataFrame, view_compat: bool = False) -> DataFrame:
    """cells (covered, blocked, has_source, later, earlier booleans, task_status, error_code) with gap_type, gap_reason,
    failed_stage, cell_status and actionable; a null flag is false.

    view_compat: a region without an active source waits for verification, and a failed task shows its stage
    whatever the cell is.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_source = is_("blocked") | ~is_("has_source")
    waits = is_("later") | is_("earlier") | (no_source if view_compat else is_("blocked"))
    failed = F.coalesce(F.col("task_status") == "failed", F.lit(False))
    reason = F.when(is_("covered"), None).when(no_source, "no_source").when(is_("later"), "not_published").when(failed, "failed").otherwise("not_attempted")
    stage = failed_stage(F.col("error_code"))
    status = F.when(is_("covered"), "in_lake").when(F.col("task_status") == "pending", "queued").when(F.col("task_status") == "running", "crawling").when(failed, "failed").otherwise("missing")
    out = cells.withColumn("gap_type", F.when(is_("covered"), "covered").when(waits, "pending_verify").otherwise("missing")).withColumn("gap_reason", reason)
    out = out.withColumn("failed_stage", F.when(failed if view_compat else F.col("gap_reason") == "failed", stage))
    return out.withColumn("cell_status", status).withColumn("actionable", F.coalesce(F.col("gap_reason").isin(*ACTIONABLE), F.lit(False)))


def gap_view(archives: DataFrame, declared: DataFrame, tasks: DataFrame, sources: DataFrame, view_compat: bool = False) -> DataFrame:
    """Every (region_code, period) that an archive, a declaration or a task names, classified.

    archives: region_code, period, archive_id; declared: region_code, period; tasks: region_code, period, task_id,
    status, error_code, created_at (the latest counts, the greatest id of equals); sources: region_code,
    is_active, is_blocked. Each side is aggregated to its key before it is joined; cells without region or
    period are left out.
    """
    key = ["region_code", "period"]
    named = lambda rows: rows.where("region_code IS NOT NULL AND period IS NOT NULL")
    counts = named(archives).groupBy(*key).agg(F.count_distinct("archive_id").alias("archives"), F.lit(None).cast("boolean").alias("declared"))
    said = named(declared).select(*key).distinct().select(*key, F.lit(None).cast("long").alias("archives"), F.lit(True).alias("declared"))
    evidence = counts.unionByName(said).groupBy(*key).agg(F.coalesce(F.max("archives"), F.lit(0)).alias("archives"), F.coalesce(F.max("declared"), F.lit(False)).alias("declared"))
    bounds = evidence.groupBy("region_code").agg(F.min("period").alias("earliest"), F.max("period").alias("latest"))
    newest = named(tasks).groupBy(*key).agg(F.max_by(F.struct("task_id", "status", "error_code"), F.struct("created_at", "task_id")).alias("task"))
    known = sources.groupBy("region_code").agg(F.bool_or("is_active").alias("has_source"), F.bool_or("is_blocked").alias("blocked"))
    cells = evidence.join(newest, key, "full").join(bounds, "region_code", "left").join(known, "region_code", "left")
    flags = cells.select(*key, F.coalesce("archives", F.lit(0)).alias("archives"), ((F.coalesce("archives", F.lit(0)) > 0) | F.coalesce("declared", F.lit(False))).alias("covered"), "blocked", "has_source",
                         (F.col("period") > F.col("latest")).alias("later"), (F.col("period") < F.col("earliest")).alias("earlier"), "task.task_id", F.col("task.status").alias("task_status"), F.col("task.error_code").alias("error_code"))
    return classified(flags, view_compat).select(*key, "archives", "gap_type", "gap_reason", "failed_stage", "cell_status", "actionable", "task_id", "task_status")


def spine(targets: DataFrame, periods: DataFrame) -> DataFrame:
    """Every target with every period; both are dimensions, and the periods are the smaller."""
    return targets.crossJoin(F.broadcast(periods))


#: A region that a source says it covers. declared_periods are months in any written form.
TARGET = (
    "region_code string, region_name string, target_level string, requires_city_source boolean, source_completeness_status string, source_audit_status string, "
    "source_audit_note string, city_source_url string, coverage_note string, declared_periods array<string>"
)
# Notes on months after the latest issue and before the first.
LATER_NOTE, EARLIER_NOTE = "未发布或发布节奏待核，不按采集失败处理", "历史期次待回填核验，不按采集失败处理"


def _scope(scope: Column) -> Column:
    return F.when(scope == "municipality", "city").otherwise(scope)


def target_rows(sources: DataFrame) -> DataFrame:
    """A row for every source and target region that it names; a source that names none covers its own region.

    sources: source_id, seq (their order), name, region_code, province, city, scope, publisher_region_code,
    coverage_region_code, remark, targets (array of TARGET).
    """
    own = F.struct(
        F.coalesce("coverage_region_code", "region_code").alias("region_code"), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("city", "province", "name")]).alias("region_name"), F.lit(None).cast("string").alias("target_level"),
        F.coalesce(_scope(F.col("scope")) == "city", F.lit(False)).alias("requires_city_source"), F.lit("pending_source_audit").alias("source_completeness_status"), F.lit(None).cast("string").alias("source_audit_status"),
        F.lit(None).cast("string").alias("source_audit_note"), F.lit(None).cast("string").alias("city_source_url"), F.col("remark").alias("coverage_note"), F.lit(None).cast("array<string>").alias("declared_periods"),
    )
    named = F.coalesce(F.size("targets") > 0, F.lit(False))
    rows = sources.select("source_id", "seq", "region_code", _scope(F.col("scope")).alias("scope"), "publisher_region_code", named.alias("named"), F.posexplode(F.when(named, F.col("targets")).otherwise(F.array(own))).alias("at", "t"))
    publisher = F.coalesce(F.nullif(F.col("publisher_region_code"), F.lit("")), "region_code")
    region = F.coalesce(F.nullif(F.col("t.region_code"), F.lit("")), "region_code", F.lit(""))
    return rows.select(
        F.when(F.length(publisher) >= 2, F.concat(F.substring(publisher, 1, 2), F.lit("0000"))).alias("province_code"), region.alias("coverage_region_code"), "source_id", "scope", F.struct("seq", "at").alias("order"), "named",
        F.col("t.region_name").alias("name"), target_level(F.col("t.target_level"), region).alias("level"), F.coalesce("t.requires_city_source", F.lit(False)).alias("requires_city"),
        F.coalesce(F.nullif(F.col("t.source_completeness_status"), F.lit("")), F.lit("pending_source_audit")).alias("status"), "t.source_audit_status", "t.source_audit_note", "t.city_source_url", "t.coverage_note", "t.declared_periods",
    )


def targets_of(rows: DataFrame) -> DataFrame:
    """The distinct (province_code, coverage_region_code) of target_rows: of what several sources say the first counts, a name that a
    target gives before one that is only the source's own; one that says blocked or asks for a city source is enough.
    Sources that aren't blocked there are registered, by scope."""
    said = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("order"))).alias(c)
    registered = lambda scope: F.array_sort(F.collect_set(F.when((F.col("status") != "source_blocked") & (F.col("scope") == scope), F.col("source_id")))).alias(f"{scope}_registered")
    given = F.min_by("name", F.when(F.col("named") & (F.coalesce("name", F.lit("")) != ""), F.col("order")))
    return rows.groupBy("province_code", "coverage_region_code").agg(
        F.coalesce(given, F.min_by("name", "order")).alias("coverage_region_name"), F.min_by("level", F.when(F.col("level").isNotNull(), F.col("order"))).alias("target_level"), F.bool_or("requires_city").alias("requires_city"),
        F.bool_or(F.col("status") == "source_blocked").alias("blocked"), said("source_audit_status"), said("source_audit_note"), said("city_source_url"), said("coverage_note"), registered("province"), registered("city"),
    )


def matrix(sources: DataFrame, archives: DataFrame, files: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each target region and month from first to last, with 22 columns: what covers it, where from, and how
    complete its sources are.

    sources as in target_rows, with entry_url, official_url, public_url, url and base_url; archives: archive_id, title, region_code,
    period, source_id, publisher_scope (that of the source if null), issue_label; files: archive_id, file_id, file_name, is_primary,
    representation_role, sort_order, added_at. An archive of a part of a region (510100-xx) counts for the region too. A month that
    a source declares is covered without an archive. Months beyond what a region has, and those of blocked
    regions, wait for verification. Every branch is aggregated to its cell before it is joined, so none
    multiplies another; the months are a list made here, so their number is known.
    """
    rows = target_rows(sources)
    targets = targets_of(rows)
    cell, key = ["coverage_region_code", "period"], ["province_code", "coverage_region_code"]
    periods = targets.sparkSession.range(1).select(F.explode(months_between(F.lit(first), F.lit(last))).alias("period"))
    scopes = sources.select("source_id", F.col("scope").alias("own_scope"))
    placed = archives.join(scopes, "source_id", "left").withColumn("scope", F.coalesce("publisher_scope", "own_scope"))
    placed = placed.withColumn("coverage_region_code", F.explode(region_and_parent(F.col("region_code")))).where("period IS NOT NULL")
    ids = lambda scope: F.collect_set(F.when(F.col("scope") == scope, F.col("source_id"))).alias(f"{scope}_evidence")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    evidence = placed.groupBy(*cell).agg(F.min("issue_label").alias("period_label"), F.array_sort(F.collect_set(title)).alias("evidence_titles"), F.array_sort(F.collect_list("archive_id")).alias("evidence_archive_ids"), ids("province"), ids("city"))
    rank = F.struct(~F.col("is_primary"), F.col("representation_role") != "primary", F.col("sort_order"), F.col("added_at"), F.col("file_id"))
    mounted = placed.select(*cell, "archive_id").join(files.where("file_id IS NOT NULL"), "archive_id").groupBy(*cell).agg(F.min_by(F.struct("file_id", "file_name"), rank).alias("primary"), F.count("*").alias("files"))
    months = F.filter(F.transform("declared_periods", month_of), lambda m: m.isNotNull())
    declared = rows.select(*key, "source_id", "scope", F.explode(F.array_distinct(months)).alias("period"))
    said = lambda scope: F.collect_set(F.when(F.col("scope") == scope, F.col("source_id"))).alias(f"{scope}_declared")
    declarations = declared.groupBy(*key, "period").agg(said("province"), said("city"))
    observed = evidence.groupBy("coverage_region_code").agg(F.min("period").alias("e_min"), F.max("period").alias("e_max"))
    promised = declared.groupBy(*key).agg(F.min("period").alias("d_min"), F.max("period").alias("d_max"))

    cells = spine(targets, periods).join(evidence, cell, "left").join(mounted, cell, "left").join(declarations, [*key, "period"], "left").join(observed, "coverage_region_code", "left").join(promised, key, "left")
    none = F.array().cast("array<string>")
    of = lambda scope: F.array_sort(F.array_union(F.array_union(F.coalesce(f"{scope}_evidence", none), F.coalesce(f"{scope}_declared", none)), F.col(f"{scope}_registered")))
    cells = cells.withColumn("provinces", of("province")).withColumn("cities", of("city"))
    covered = F.coalesce(F.size("evidence_archive_ids") > 0, F.lit(False)) | F.coalesce((F.size("province_declared") > 0) | (F.size("city_declared") > 0), F.lit(False))
    later = ~covered & F.coalesce(F.col("period") > F.greatest("e_max", "d_max"), F.lit(False))
    earlier = ~covered & F.coalesce(F.col("period") < F.least("e_min", "d_min"), F.lit(False))
    n_province, n_city = F.size("provinces").cast("long"), F.size("cities").cast("long")
    complete = F.when((n_province > 0) & (n_city > 0), "dual_source").when(n_city > 0, "city_source_present").when(F.col("blocked"), "source_blocked").when((n_province > 0) & F.col("requires_city"), "city_source_missing").when(n_province > 0, "province_source_only").otherwise("pending_source_audit")
    note = F.array_join(F.array_compact(F.array(F.nullif(F.col("coverage_note"), F.lit("")), F.when(later, LATER_NOTE), F.when(earlier, EARLIER_NOTE))), "；")
    # The first source that has a url, those of the city before those of the province.
    links = sources.select("source_id", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("entry_url", "official_url", "public_url", "url", "base_url")]).alias("link")).where("link IS NOT NULL")
    asked = cells.select(*key, "period", F.posexplode(F.concat("cities", "provinces")).alias("at", "source_id"))
    visits = asked.join(links, "source_id").groupBy(*key, "period").agg(F.min_by("link", "at").alias("visit"))
    return cells.join(visits, [*key, "period"], "left").select(
        "province_code", "coverage_region_code", "coverage_region_name", "target_level", "period", "period_label", F.coalesce("evidence_titles", none).alias("evidence_titles"), F.coalesce("evidence_archive_ids", F.array().cast(dict(evidence.dtypes)["evidence_archive_ids"])).alias("evidence_archive_ids"),
        F.col("primary.file_id").alias("primary_file_id"), F.col("primary.file_name").alias("primary_file_name"), F.concat(F.lit("/api/file-assets/"), F.col("primary.file_id").cast("string"), F.lit("/download")).alias("primary_download_url"), F.coalesce("files", F.lit(0)).alias("file_count"),
        F.when(covered, "covered").when(F.col("blocked") | later | earlier, "pending_verify").otherwise("missing").alias("business_coverage_status"), complete.alias("source_completeness_status"), "source_audit_status", "source_audit_note", "city_source_url",
        F.coalesce(F.nullif(F.col("city_source_url"), F.lit("")), "visit").alias("source_visit_url"), n_province.alias("province_source_count"), n_city.alias("city_source_count"), F.concat("provinces", "cities").alias("source_ids"), F.nullif(note, F.lit("")).alias("coverage_note"),
    )


def coverage_stats(cells: DataFrame) -> DataFrame:
    """One row over the matrix: cells in all, covered, waiting for verification and missing."""
    state = lambda x: F.count_if(F.col("business_coverage_status") == x)
    return cells.agg(F.count("*").alias("total"), state("covered").alias("covered"), state("pending_verify").alias("pending_verify"), state("missing").alias("missing"))


def filtered_cells(cells: DataFrame, city: str | None = None, period: str | None = None, years: tuple[int, int] | None = None, business: str | None = None, sources: str | None = None, query: str = "") -> DataFrame:
    """Cells of the matrix of a city and its parts (by the first four digits), a month or a range of years, in a state, whose
    codes, names and notes hold the query, whatever its case. Without a month the years decide; a month that is none stays."""
    if city:
        cells = cells.where((F.col("coverage_region_code") == city) | F.startswith("coverage_region_code", F.lit(city[:4])))
    if period:
        cells = cells.where(F.col("period") == period)
    elif years:
        year = F.regexp_extract("period", r"^(\d{4})-\d{2}$", 1).try_cast("int")
        cells = cells.where(year.isNull() | year.between(*years))
    if business:
        cells = cells.where(F.col("business_coverage_status") == business)
    if sources:
        cells = cells.where(F.col("source_completeness_status") == sources)
    if query.strip():
        texts = ("coverage_region_code", "coverage_region_name", "period", "business_coverage_status", "source_completeness_status", "source_audit_status", "coverage_note", "source_audit_note")
        cells = cells.where(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(query.strip().lower())))
    return cells


def issue_groups(archives: DataFrame) -> DataFrame:
    """(region, period, n, ids): how many archives, and their sorted ids as text."""
    return archives.groupBy("region", "period").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def backfill_plan(wanted: DataFrame, cells: DataFrame, sources: DataFrame, tasks: DataFrame, include_covered: bool = False) -> DataFrame:
    """(region_code, period, source_id, outcome) for every wanted (region_code, period): why it is skipped, or `task`.

    cells: region_code, period, status; sources: region_code, source_id, of which a region's smallest serves;
    tasks: source_id, period, status.
    """
    serving = sources.groupBy("region_code").agg(F.min("source_id").alias("source_id"))
    busy = tasks.where(F.col("status").isin("pending", "running")).select("source_id", "period", F.lit(True).alias("busy")).distinct()
    joined = wanted.select("region_code", "period").distinct().join(cells.select("region_code", "period", "status"), ["region_code", "period"], "left").join(serving, "region_code", "left").join(busy, ["source_id", "period"], "left")
    skip = F.when(F.col("status").isNull(), "coverage_cell_not_found")
    if not include_covered:
        skip = skip.when(F.col("status") == "covered", "covered")
    outcome = skip.when(F.col("source_id").isNull(), "source_not_found").when(F.col("busy"), "pending_or_running_exists").otherwise("task")
    return joined.select("region_code", "period", "source_id", outcome.alias("outcome"))


def book_cells(archives: DataFrame) -> DataFrame:
    """One row per (year, row_code) of archives (archive_id, title, year, row_code, parse_status): their number, sorted
    ids, titles sorted with their statuses beside, and the histogram of statuses. An unknown year is a year."""
    rows = archives.select(F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year"), "row_code", "archive_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("parse_status", F.lit("unknown")).alias("status"))
    counts = rows.groupBy("year", "row_code", "status").agg(F.count("*").alias("n"), F.collect_list("archive_id").alias("ids"), F.collect_list(F.struct("title", "archive_id", "status")).alias("books"))
    cells = counts.groupBy("year", "row_code").agg(F.sum("n").alias("archives"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("archive_ids"), F.array_sort(F.flatten(F.collect_list("books"))).alias("books"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    shown = F.filter("books", lambda b: b["title"] != "")
    return cells.select("year", "row_code", "archives", "archive_ids", F.transform(shown, lambda b: b["title"]).alias("titles"), F.transform(shown, lambda b: b["status"]).alias("title_statuses"), "statuses")
