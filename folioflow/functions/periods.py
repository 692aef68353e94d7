"""Publication periods, regions and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese numerals up to twelve.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12}
# The forms in which a month is written, in the order in which they are tried.
MONTH_FORMS = (r"(?<!\d)(\d{4})-(0[1-9]|1[0-2])", r"(?<!\d)(\d{4})年(0?[1-9]|1[0-2])月", r"(?<!\d)(\d{4})[/.](1[0-2]|0?[1-9])")


def month_of(text: Column) -> Column:
    """YYYY-MM of the first form that matches, else null."""
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.concat_ws("-", F.regexp_extract(text, p, 1), F.lpad(F.regexp_extract(text, p, 2), 2, "0"))) for p in MONTH_FORMS]
    return F.coalesce(*found)


def period_of(*candidates: Column) -> Column:
    """The month of the first candidate that has one."""
    return F.coalesce(*[month_of(c.cast("string")) for c in candidates])


def months_between(start: Column, end: Column) -> Column:
    """All YYYY-MM from start to end, both YYYY-MM; none if end is earlier."""
    a, b = F.to_date(F.concat(start, F.lit("-01"))), F.to_date(F.concat(end, F.lit("-01")))
    steps = F.when(a <= b, F.sequence(a, b, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(steps, lambda d: F.date_format(d, "yyyy-MM"))


def numeral(text: Column) -> Column:
    """A number up to twelve in Arabic, full-width or Chinese digits."""
    plain = F.translate(text, "０１２３４５６７８９", "0123456789")
    known = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return F.coalesce(plain.try_cast("int"), known[plain])


def issue_of(text: Column) -> Column:
    """The number n of 第n期, else null."""
    raw = F.regexp_extract(text, "第\\s*([0-9０-９一二三四五六七八九十]+)\\s*期", 1)
    return F.when(raw != "", numeral(raw))


def province_of(code: Column) -> Column:
    return F.when(code.rlike("^[0-9]{2}"), F.concat(F.substring(code, 1, 2), F.lit("0000")))


def region_and_parent(code: Column) -> Column:
    """The codes a region counts for: itself, and the six digits before a dash."""
    return F.array_compact(F.array(code, F.when(code.rlike("^[0-9]{6}-"), F.substring(code, 1, 6))))


def in_window(period: Column, first: str | None, last: str | None) -> Column:
    """Whether a period lies between the bounds; a null one does only without bounds."""
    ok = F.lit(True)
    if first:
        ok = ok & F.coalesce(period >= first, F.lit(False))
    if last:
        ok = ok & F.coalesce(period <= last, F.lit(False))
    return ok


def due(policy: Column, last: Column, now: Column, zone: str = "Asia/Shanghai") -> Column:
    """Whether a source is due: daily on another local day, weekly after seven days, monthly in another month; never run is due."""
    here = lambda t: F.from_utc_timestamp(t, zone)
    day = F.to_date(here(last)) != F.to_date(here(now))
    week = F.datediff(here(now), here(last)) >= 7
    month = F.date_format(here(last), "yyyy-MM") != F.date_format(here(now), "yyyy-MM")
    return F.when(last.isNull(), True).when(policy == "daily", day).when(policy == "weekly", week).when(policy == "monthly", month).otherwise(False)


def next_slot(now: Column, days: list[int], times: list[str], zone: str = "Asia/Shanghai") -> Column:
    """The first of the local days of the month and times after now, as UTC; within fourteen months."""
    local = F.from_utc_timestamp(now, zone)
    months = F.sequence(F.trunc(local, "month"), F.add_months(F.trunc(local, "month"), 14), F.expr("interval 1 month"))
    dates = F.flatten(F.transform(months, lambda m: F.filter(F.transform(F.array(*map(F.lit, days)), lambda d: F.date_add(m, d - 1)), lambda x: F.trunc(x, "month") == m)))
    slots = F.flatten(F.transform(dates, lambda d: F.transform(F.array(*map(F.lit, times)), lambda t: F.to_timestamp(F.concat_ws(" ", d.cast("string"), t)))))
    return F.to_utc_timestamp(F.array_min(F.filter(slots, lambda s: s > local)), zone)


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(60) * F.pow(F.lit(2.0), attempt), F.lit(14400.0)).cast("long")


def lag_days(published: Column, crawled: Column) -> Column:
    return F.greatest(F.datediff(crawled, published), F.lit(0))


# The forms in which a user writes a period: year and number, by groups.
TOKEN_FORMS = (r"^(?:20)?(\d{2})年(?:第(\d{1,2})期|(\d{1,2})[月期])$", r"^20(\d{2})(\d{2})$", r"^(?:20)?(\d{2})[-./]?(\d{1,2})$")
# A year and an issue or month in a title.
TITLE_FORM = r"(20\d{2})\s*年(?:第\s*(\d{1,2})\s*期|(\d{1,2})\s*月)"


def _number(text: Column, form: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, form, group), F.lit("")).try_cast("int")


def token_period(token: Column) -> Column:
    """YYYY-MM of a period as users write it (2026-2, 26.2, 2026年第3期, 202603), else null; two digits are a year from 2000 on."""
    text, found = F.trim(token), []
    for form in TOKEN_FORMS:
        parts = [_number(text, form, 2)] + ([_number(text, form, 3)] if form == TOKEN_FORMS[0] else [])
        found.append(F.when(text.rlike(form), F.struct(_number(text, form, 1).alias("y"), F.coalesce(*parts).alias("n"))))
    got = F.coalesce(*found)
    return F.when(got["n"].between(1, 12), F.format_string("20%02d-%02d", got["y"], got["n"]))


def title_period(title: Column) -> Column:
    """(year, number) of the first year with an issue or month in a title, else null."""
    year, number = _number(title, TITLE_FORM, 1), F.coalesce(_number(title, TITLE_FORM, 2), _number(title, TITLE_FORM, 3))
    return F.when(year.isNotNull(), F.struct(year.alias("year"), number.alias("number")))


def edition_year(year: Column, label: Column, title: Column, noted: Column) -> Column:
    """A book's year as four digits: its own, else one in its label, its title, or a note; null if none has one."""
    inside = lambda c: F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit(""))
    bare = lambda c: F.when(F.trim(c).try_cast("int").between(1900, 2099), F.trim(c))
    return F.coalesce(F.lpad(year.cast("int").cast("string"), 4, "0"), inside(label), bare(label), inside(title), inside(noted), bare(noted))


def legal_status(effective: Column, today: Column) -> Column:
    return F.when(effective.isNull(), "unknown").when(F.to_date(effective) <= F.to_date(today), "effective").otherwise("pending")


def issue_period(title: Column, pattern: str) -> Column:
    """(period, year, issue_no, issue_end_no) of a title by a pattern whose first group is the year and whose second holds
    one issue or two; null where it doesn't match."""
    year, issues = F.regexp_extract(title, pattern, 1), F.regexp_extract_all(F.regexp_extract(title, pattern, 2), F.lit("[0-9]{1,2}"), F.lit(0))
    first, last = F.get(issues, F.lit(0)).cast("int"), F.get(issues, F.lit(1)).cast("int")
    period = F.concat(year, F.lit("年第"), first.cast("string"), F.coalesce(F.concat(F.lit("—"), last.cast("string")), F.lit("")), F.lit("期"))
    return F.when(year != "", F.struct(period.alias("period"), year.cast("int").alias("year"), first.alias("issue_no"), last.alias("issue_end_no")))


def bimonthly_period(title: Column, pattern: str) -> Column:
    """(period, period_start, year) of a title by a pattern whose groups are the year and two months, in any digits."""
    year, a, b = (F.regexp_extract(title, pattern, i) for i in (1, 2, 3))
    start, end = numeral(a), numeral(b)
    period = F.concat(year, F.lit("年"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("月"))
    return F.when(year != "", F.struct(period.alias("period"), F.concat(year, F.lit("-"), F.lpad(start.cast("string"), 2, "0")).alias("period_start"), year.cast("int").alias("year")))
