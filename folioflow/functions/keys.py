"""Business keys and inferred roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, key_text


def cell_value(cell: Column) -> Column:
    """The value of a provenance cell (a variant): its `value` if it is an object with one, else itself."""
    return F.coalesce(F.try_variant_get(cell, "$.value", "string"), cell.cast("string"))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _joined(*parts) -> Column:
    """Parts with colons between; a null part is an empty one."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def cost_info_key(source: Column, region: Column, period: Column, title: Column) -> Column:
    return _joined("cost_info", source, region, period, key_text(title))


def trading_key(source: Column, item: Column, title: Column, published: Column, kind: Column) -> Column:
    """By the item's own key; without one, by title, date and kind of notice."""
    return F.when(_filled(item), _joined("trading", source, item)).otherwise(_joined("trading", source, key_text(title), published, key_text(kind)))


def quota_key(source: Column, title: Column, region: Column, code: Column, version: Column, effective: Column, standard: Column) -> Column:
    """By code, version and date where all are known; else by the standard's number and version; else by title."""
    by_code = F.when(_filled(region) & _filled(code) & _filled(version) & _filled(effective), _joined("quota", region, code, version, effective))
    numbered = _filled(standard) & _filled(version)
    by_number = F.when(numbered & _filled(region), _joined("quota", region, standard, version)).when(numbered, _joined("quota", standard, version))
    return F.coalesce(by_code, by_number, _joined("quota", source, key_text(title)))


def policy_key(title: Column, authority: Column, number: Column, published: Column) -> Column:
    """By the document's number; else by sixteen digits of the hash of title, authority and date."""
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (key_text(title), key_text(authority), published.cast("string"))])
    return F.when(_filled(number), _joined("policy", number)).otherwise(_joined("policy", "hash", F.substring(F.sha2(text, 256), 1, 16)))


def atlas_key(source: Column, title: Column, standard: Column, version: Column) -> Column:
    return F.when(_filled(standard) & _filled(version), _joined("standard_atlas", standard, version)).otherwise(_joined("standard_atlas", source, key_text(title)))


# Extensions and words that tell what a file is.
PRICED, PACKED, WEB = (".zbx", ".cjz", ".cos", ".qtfx"), (".zip", ".rar", ".7z", ".cdz"), (".html", ".htm")
BILL_ROLES, BILL_WORDS = ("qingdan_package", "control_price_qingdan", "tender_qingdan"), "工程量清单|清单包|招标控制价|控制价"
DRAWING_WORDS, GROUND_WORDS, TENDER_WORDS = "工程图|施工图|设计图|图纸|图审", "地勘|勘察|岩土", "招标文件|招标资料|招标正文"


def file_role(name: Column, domain: Column, item_role: Column | None = None, primary: Column | None = None) -> Column:
    """What a file is to its publication: the first rule that fits its extension, name and domain."""
    given = F.coalesce(item_role, F.lit("")) if item_role is not None else F.lit("")
    first = F.coalesce(primary, F.lit(False)) if primary is not None else F.lit(False)
    ext, said, role, of = extension(name), key_text(name), key_text(given), F.coalesce(domain, F.lit(""))
    has = lambda words: said.rlike(words) | role.rlike(words)
    trading, quota, policy, atlas = (of == d for d in ("trading", "quota", "policy_regulation", "standard_atlas"))
    rules = [
        (ext.isin(*PRICED), "priced_source"),
        (trading & ext.isin(*PACKED) & (role.isin(*BILL_ROLES) | has(BILL_WORDS)), "qingdan_package"),
        (trading & has(DRAWING_WORDS), "drawing"),
        (trading & has(GROUND_WORDS), "geological"),
        (trading & ~ext.isin(*PACKED) & has(TENDER_WORDS), "tender_doc"),
        (ext.isin(*PACKED), "zip_package"),
        (quota & said.contains("补充") & said.contains("定额"), "quota_supplement"),
        (quota & said.contains("解释") & said.contains("定额"), "quota_interpretation"),
        (quota & said.rlike("清单|gb50500"), "bill_standard"),
        (quota & said.contains("定额"), "quota_db"),
        (policy & ~first & (said.contains("附件") | ext.isin(".xlsx", ".xls")), "policy_attachment"),
        (policy & (first | ext.isin(".pdf", ".doc", ".docx")), "policy_document"),
        (atlas & (ext.isin(".jpg", ".jpeg", ".png", ".tif", ".tiff") | said.contains("扫描")), "scan_image"),
        (atlas & said.rlike("gb|规范|标准"), "standard_document"),
        (atlas & (ext == ".pdf"), "atlas_document"),
        (given.isin("web_page_snapshot", "public_notice") | ext.isin(*WEB), "web_snapshot"),
        (ext.isin(".jpg", ".jpeg", ".png") & said.contains("封面"), "cover"),
        (first, "main_document"),
    ]
    return F.coalesce(*[F.when(test, kind) for test, kind in rules], F.lit("attachment"))


def book_category(material: Column, system: Column) -> Column:
    """One of three kinds of books, or null."""
    return F.when(material == "boq_standard", "boq_standard").when(system == "construction_regional", "construction_quota").when(system == "industry_specialty", "industry_quota")


# Words of publisher types, and the order of publishers.
STATION_WORDS = "official|government|housing|cost_station|住建|定额"
PUBLISHER_RANK = {"station:province": 10, "station:city": 20, "association:province": 30, "association:city": 40}


def publisher(kind: Column, scope: Column) -> Column:
    """group:scope of a publisher, or null where either is unknown; PUBLISHER_RANK orders them, others come last."""
    text = F.lower(F.trim(kind))
    group = F.when(text.rlike("association|协会"), "association").when(text.rlike(STATION_WORDS), "station")
    return F.when(group.isNotNull() & (F.coalesce(scope, F.lit("")) != ""), F.concat_ws(":", group, scope))


def publisher_rank(value: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PUBLISHER_RANK.items() for x in kv])[value], F.lit(100))


# Short codes of provinces, their names, and other words for them.
PROVINCES = {"sc": ("四川", "川建"), "cq": ("重庆",), "gd": ("广东", "粤"), "hu": ("湖北", "鄂"), "bj": ("北京", "京")}


def province_short(text: Column) -> Column:
    """The short code of a province given as such, by name or by another word for it; anything else, null too, raises."""
    known = {code: code for code in PROVINCES} | {word: code for code, words in PROVINCES.items() for word in words}
    found = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.trim(text)]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no such province: "), F.coalesce(text, F.lit("null")))).cast("string"))


# For each publisher, in the order they are tried, patterns of a year and a period or month in file names.
CITY_PATTERNS = {
    "成都": (
        r"成都(?:市)?信息价(\d{4})[\-年](\d{1,2})(?:期)?", r"成都(?:市)?(\d{4})年(\d{1,2})期", r"(\d{4})年成都(?:市)?信息价(\d{1,2})期", r"(\d{4})年成都(?:市)?(\d{1,2})期", r"(\d{4})年成都(?:市)?[^0-9\n]{0,20}?第?(\d{1,2})期",
    ),
    "重庆": (
        r"重庆(?:市)?[^0-9\s]{0,12}?(\d{4})[\-/年]?(\d{1,2})期", r"(\d{4})年重庆(?:市)?[^0-9\s]{0,12}?(\d{1,2})期", r"重庆(?:市)?(\d{4})年第?(\d{1,2})期", r"(\d{4})年重庆(?:市)?(\d{1,2})期", r"重庆[^0-9\s]{0,12}?(\d{4})[\-/年]?(\d{1,2})(?:期|\D|$)",
    ),
    "北京": (r"北京(?:市)?(\d{4})年(\d{1,2})月", r"(\d{4})年(\d{1,2})月北京(?:市)?"),
    "武汉": (r"武汉市建设工程综合价格信息.*?(\d{4})年(\d{1,2})月", r"(\d{4})年(\d{1,2})月武汉市"),
    "湖北": (r"(\d{4})年第(\d{1,2})期[《<]湖北工程造价管理[》>]",),
}
CITY_OF_REGION = {"440100": "广州"}


def detected_city(filename: Column, title: Column, region: Column) -> Column:
    """(city, year, period) of a file: by its name without the extension, then by its title, then by its region, where year
    and period aren't known (0 and 00); null if nothing tells."""
    kind = "struct<city:string,year:int,period:string>"
    name = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")

    def by(text: Column) -> Column:
        out = F.lit(None).cast(kind)
        for city, patterns in reversed(CITY_PATTERNS.items()):
            for p in reversed(patterns):
                own = F.struct(F.lit(city).alias("city"), F.regexp_extract(text, p, 1).cast("int").alias("year"), F.regexp_extract(text, p, 2).cast("int").cast("string").alias("period"))
                out = F.when(text.rlike(p), own.cast(kind)).otherwise(out)
        return out

    place = F.create_map(*[F.lit(x) for pair in CITY_OF_REGION.items() for x in pair])[region]
    of_region = F.when(place.isNotNull(), F.struct(place.alias("city"), F.lit(0).alias("year"), F.lit("00").alias("period")).cast(kind))
    return F.coalesce(by(name), by(F.regexp_replace(title, r"(?<=.)\.[^.]*$", "")), of_region)
