"""Text scalars: key texts, urls, numbers, units, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Traditional characters and their simplified forms in key texts.
TRADITIONAL = "價資訊綜設烏魯齊築與標準"
SIMPLIFIED = "价资讯综设乌鲁齐筑与标准"
# Query parameters that only track where a visitor came from.
TRACKING = ("spm", "from", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
# Literal unit rewrites, in this order.
UNIT_REWRITES = (
    ("<sup>2</sup>", "2"), ("<sup>3</sup>", "3"), (r"$\mathbf{m}^2$", "m2"), (r"$\mathbf{m}^3$", "m3"),
    ("m³", "m3"), ("m²", "m2"), ("m^3", "m3"), ("m^2", "m2"),
)
# Names of units and the unit each stands for.
UNIT_NAMES = {
    "kg": "kg", "千克": "kg", "公斤": "kg", "t": "t", "吨": "t", "m3": "m³", "m³": "m³", "立方米": "m³", "m2": "m²", "m²": "m²", "平方米": "m²",
    "m": "m", "米": "m", "个": "个", "套": "套", "台班": "台班", "工日": "工日", "工": "工日", "元": "元", "千块": "千块", "L": "L", "升": "L",
}


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def key_text(text: Column) -> Column:
    """Text for business keys: NFKC, simplified, lower case, no quotation marks, brackets and runs of space as one space."""
    plain = F.lower(F.trim(F.translate(nfkc(text), TRADITIONAL, SIMPLIFIED)))
    bare = F.regexp_replace(plain, "[《》“”\"'`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[（）()【】\[\]{}]", " "), r"\s+", " "))


# Schemes whose urls have a host even when it is empty.
HOST_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss", "sftp")


def _decoded(text: Column) -> Column:
    """Form encoding undone; a text with a broken escape only has its plus signs read as blanks."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    """Form encoding in which letters, digits and _.-~ stand for themselves."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column) -> Column:
    """A url for comparison: scheme (https if there is none) and host in lower case, the fragment and tracking parameters gone,
    the other parameters decoded, sorted and encoded again. A url with an open bracket in its host stays as it is."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|\s+$", ""), "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_extract(p, "=(.*)$", 1))).otherwise("").alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    form = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    place = F.when((host != "") | scheme.isin(*HOST_SCHEMES), F.concat(F.lit("//"), F.lower(host), rooted)).otherwise(path)
    whole = F.concat(scheme, F.lit(":"), place, F.when(form != "", F.concat(F.lit("?"), form)).otherwise(""))
    return F.when(F.contains(host, F.lit("[")) != F.contains(host, F.lit("]")), url).otherwise(whole)


def url_key_plain(url: Column) -> Column:
    """url_key without decoding, for urls that have no escapes; parameters stay as they are written."""
    host = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def first_number(text: Column) -> Column:
    """The first number after commas, blanks and dashes are removed; null if there is none."""
    return F.regexp_extract(F.translate(text, ", —-", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")


def number_or_zero(text: Column) -> Column:
    """A number out of brackets, without commas and blanks; 0 if it is none."""
    inner = F.regexp_replace(F.trim(text), r"^[(（]\s*(.*?)\s*[)）]$", "$1")
    return F.coalesce(F.translate(inner, ", ", "").try_cast("double"), F.lit(0.0))


def number_or_null(text: Column) -> Column:
    return F.translate(F.trim(text), ",", "").try_cast("double")


def out_of_brackets(text: Column) -> Column:
    """(10.500) as 10.500; anything else as it is."""
    inner = F.regexp_extract(F.trim(text), r"^[(（]\s*([0-9.,]+)\s*[)）]$", 1)
    return F.when(inner != "", inner).otherwise(text)


def plain_number(value: Column) -> Column:
    """Two decimals without closing zeros."""
    fixed = F.regexp_replace(F.call_function("format_number", value, F.lit("0.00")), r"\.?0+$", "")
    return F.when(F.isnan(value), None).otherwise(fixed)


def integral(value: Column) -> Column:
    """A cell's number as text: whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def tax_rate(with_tax: Column, without: Column) -> Column:
    """The tax between two prices as a percentage text; empty unless both are numbers and it is above zero."""
    a, b = number_or_null(with_tax), number_or_null(without)
    rate = F.round((a / F.when(b != 0, b) - 1) * 100, 2)
    return F.when(rate > 0, F.concat(rate.cast("string"), F.lit("%"))).otherwise("")


def unit(text: Column) -> Column:
    """The literal rewrites and nothing else."""
    out = text
    for old, new in UNIT_REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII, runs of space as one."""
    wide = "".join(chr(c + 0xFEE0) for c in range(33, 127)) + "　"
    return F.trim(F.regexp_replace(F.translate(text, wide, "".join(map(chr, range(33, 127))) + " "), r"\s+", " "))


def resource_text(text: Column) -> Column:
    """A resource's text in half-width forms; a text that is a unit's name as that unit."""
    plain = half_width(text)
    known = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    return F.coalesce(known[plain], plain)


def resource_name(text: Column) -> Column:
    """resource_text without blanks inside parentheses' edges."""
    return F.regexp_replace(F.regexp_replace(resource_text(text), r"\(\s+", "("), r"\s+\)", ")")


def markup_unit(text: Column) -> Column:
    """A unit out of formula markup: $100 m^{3}$ as 100m3; dashes alone are none, and a bare k is kg."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\\mathrm|\\mathbf|[{}\s]", ""), r"\^", "")
    formula = F.regexp_extract(bare, r"\$(\d*m[23]?)\$", 1)
    return F.when(F.trim(text).rlike("^[-−–—]+$"), "").when(formula != "", formula).when(F.trim(text) == "k", "kg").otherwise(F.coalesce(F.trim(text), F.lit("")))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.filter(F.array(text), lambda t: t != ""))


def similarity(a: Column, b: Column) -> Column:
    """Shared bigrams over the larger number of them: 1 for equal texts, 0 if either is empty."""
    x, y = bigrams(a), bigrams(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def blob_key(sha: Column, ext: Column) -> Column:
    """Where content of that digest lies: objects/aa/bb/<digest><extension>."""
    return F.concat(F.lit("objects/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, ext)


def safe_path(text: Column) -> Column:
    """A path component without separators and control characters."""
    return F.trim(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]+', "_"))


@F.pandas_udf(StringType())
def repaired_name(names: pd.Series) -> pd.Series:
    """A file name whose GBK bytes were read as Latin-1, read again; others stay."""

    def one(name: str) -> str:
        try:
            again = name.encode("latin-1").decode("gbk")
        except UnicodeError:
            return name
        return again if any("一" <= c <= "鿿" for c in again) else name

    return names.map(one, na_action="ignore")


def spaced(text: Column) -> Column:
    """A space between Chinese and Latin or Greek letters or digits that touch."""
    han, latin = "\\p{IsHan}", "A-Za-z0-9\\p{IsGreek}"
    return F.regexp_replace(F.regexp_replace(text, f"([{han}])([{latin}])", "$1 $2"), f"([{latin}])([{han}])", "$1 $2")


# The characters of the watermark of scanned books.
WATERMARK = "四川省住房和城乡建设厅信息公开浏览专用"


def without_watermark(text: Column, characters: str = WATERMARK) -> Column:
    """Text without white space; none if it is only characters of the watermark."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.when(bare.rlike(f"^[{characters}]+$"), "").otherwise(bare)


def attachment_fingerprint(detail_url: Column, attachments: Column) -> Column:
    """A digest of an issue's page and attachments, whatever their order: of the JSON object of both, keys in order."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(attachments), quoted), ","), F.lit("]"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"attachment_urls":'), listed, F.lit(',"detail_url":'), F.coalesce(quoted(detail_url), F.lit("null")), F.lit("}")), 256))
