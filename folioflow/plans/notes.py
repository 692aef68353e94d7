"""Pages of norm books by kind, their notes, and coefficients in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell what a page is.
PRICE_WORDS = "基价|人工费|材料费|机械费|综合基价"
APPENDIX_WORDS = "附录|取定|单价|材料价格|机械台班单价"
NOTE_WORDS = "说明|计算规则|工程量计算|章说明|节说明"
COVER_WORDS = "目录|前言|编制单位|主编单位|批准部门|总说明|册说明"
# How notes begin, and what they speak of.
NOTE_START = r"(?:^|\n)(?:\d+[.、]|说明|注[：:])"
SCOPE = r"(?:本章|本节|本定额)\s*(?:适用于|包括|不适用于|不包括)\s*.+?(?:[。；;]|$)"
RULE = r"计算\s*规则|工程量|按.*计算|乘以\s*(?:系数)?\s*[\d.]+|乘以系数"
COEFFICIENT = r"(?:系数|乘\s*以|调整|增加|减少|乘以)\s*([\d.]+)"


def page_kinds(blocks: DataFrame, code: str = r"^[A-Z]{2}\d{4}$", chapter: str = r"^[A-Z]\.\d+") -> DataFrame:
    """(page, kind) of blocks (page, type, text, html): a table with codes or prices, an appendix of prices, cover or
    contents, a chapter's title, notes; any other table counts as one of norms. Flags are one aggregate."""
    table = F.col("type") == "table"
    text = F.when(~table | F.col("type").isNull(), F.trim("text"))
    any_of = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    flags = blocks.groupBy("page").agg(
        any_of(table).alias("table"), any_of(table & (F.col("html").rlike(code) | F.col("html").rlike(PRICE_WORDS))).alias("norm"), any_of(table & F.col("html").rlike(APPENDIX_WORDS)).alias("appendix"),
        any_of(text.rlike(chapter)).alias("chapter"), any_of(F.substring(text, 1, 30).rlike(NOTE_WORDS)).alias("notes"), any_of(text.rlike(COVER_WORDS)).alias("cover"),
    )
    kind = F.when(F.col("norm"), "quota_table").when(F.col("appendix"), "appendix_price").when(F.col("cover"), "cover_toc").when(F.col("table"), "quota_table")
    return flags.select("page", kind.when(F.col("chapter"), "chapter_title").when(F.col("notes"), "notes").otherwise("other").alias("kind"))


def note_kind(text: Column) -> Column:
    return F.when(text.rlike(SCOPE), "scope").when(text.rlike(RULE), "calc_rule").otherwise("other")


def notes(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, note_no, kind, text) of whole texts, cut where a number, 说明 or 注 begins a line. Parts of fewer than five
    characters are left out; a text without any other part is one note of kind other, a blank one none."""
    whole = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    parts = F.filter(F.transform(F.split(whole, NOTE_START), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= 5)
    rows = pages.select(F.col(key), whole.alias("__whole"), parts.alias("__parts")).where("__whole <> ''")
    kinds = F.when(F.size("__parts") > 0, F.transform("__parts", lambda p: F.struct(note_kind(p).alias("kind"), p.alias("text")))).otherwise(F.array(F.struct(F.lit("other").alias("kind"), F.col("__whole").alias("text"))))
    return rows.select(F.col(key), F.posexplode(kinds).alias("note_no", "n")).select(key, "note_no", "n.kind", "n.text")


def coefficients(rows: DataFrame, key: str, text: str, around: int = 50) -> DataFrame:
    """(key, hit_no, keyword, value, source_text, active) for every coefficient, with what stands around it. None is
    active until someone confirms it. Texts are cut at the hits, so each position is known without Python."""
    body = F.col(text)
    hits, gaps = F.regexp_extract_all(body, F.lit(COEFFICIENT), F.lit(0)), F.split(body, COEFFICIENT, -1)
    found = rows.select(F.col(key), body.alias("__t"), hits.alias("__h"), gaps.alias("__g")).where(F.size("__h") > 0)
    found = found.select(key, "__t", "__h", "__g", F.posexplode("__h").alias("hit_no", "keyword"))
    # What stands before a hit: all gaps up to it, and all hits before it.
    width = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p))
    start = width(F.col("__g"), F.col("hit_no") + 1) + width(F.col("__h"), F.col("hit_no"))
    at = found.withColumn("__s", start).withColumn("value", F.regexp_extract("keyword", COEFFICIENT, 1).try_cast("double")).where("value IS NOT NULL")
    low = F.greatest(F.col("__s") - around, F.lit(0))
    shown = F.trim(F.substring(F.col("__t"), low + 1, F.col("__s") + F.length("keyword") + around - low))
    return at.select(key, "hit_no", "keyword", "value", shown.alias("source_text"), F.lit(False).alias("active"))
