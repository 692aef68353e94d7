"""Format-preserving pseudonyms for personal numbers, dates and addresses (operator 4). DataFrame functions only.

Every kind is written as pairs of numbers below two moduli; an eight-round Feistel network keyed with SHA-256
permutes a pair, so the map is a bijection of the format: equal values stay equal across documents, different ones
stay different, and the key's owner can go back. Letters become letters of the same case, digits digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Digits that two 63-bit numbers hold, up to base 36.
BLOCK = 24
#: The Gregorian calendar repeats after 146,097 = 189 x 773 days: 400 years from this day on are permuted.
EPOCH, DATE_MODULI = "1800-01-01", (189, 773)
#: Days of a month after its twelfth, but for 29 February: what a date with the day first can be told by.
_LATE = (19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19)
#: What may be personal data; the validity of a match is judged afterwards.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b|\b0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}\b",
    "card": r"\b[0-9]{13,19}\b|\b[0-9]{4}(?:[ -][0-9]{4}){3}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
}
ANY = "|".join(PATTERNS.values())


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _with(value: Column, make) -> Column:
    """make(value), with value worked out once."""
    return F.transform(F.array(value), make)[0]


def _char_sum(chars: Column, step) -> Column:
    """Fold single characters into a long, from the left."""
    return F.aggregate(F.regexp_extract_all(chars, F.lit("(?s)."), F.lit(0)), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), step)[0]


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits in which the last one is doubled: that of a number without its check digit."""
    def step(acc, c):
        d = c.cast("long")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.array(acc[0] + F.when(acc[1] % 2 == 0, twice).otherwise(d), acc[1] + 1)

    return _char_sum(F.reverse(digits), step)


def _mod97(text: Column) -> Column:
    """The IBAN remainder of letters and digits; anything else is passed over."""
    def step(acc, c):
        v = F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
        return F.when(c.rlike("[^A-Z0-9]"), acc).otherwise(F.array(F.when(v > 9, (acc[0] * 100 + v) % 97).otherwise((acc[0] * 10 + v) % 97), acc[1]))

    return _char_sum(text, step)


def _feistel(a: Column, b: Column, of_a: Column, of_b: Column, tag: Column, key: str) -> Column:
    """(a, b), a below of_a and b below of_b, permuted; the tag keeps kinds and lengths apart."""
    def value(i, other):
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")

    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    step = lambda s, i: F.when(i % 2 == 0, pair((s["a"] + value(i, s["b"])) % of_a, s["b"])).otherwise(pair(s["a"], (s["b"] + value(i, s["a"])) % of_b))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(a.cast("long"), b.cast("long")), step)


def _string(text: Column, base: int, tag: Column, key: str) -> Column:
    """A string of up to 64 digits below `base`, permuted among those of its length. Over BLOCK of them, the last, first and
    third block are permuted in turn, each by a key of its own for every text around it, which is a bijection too."""
    n = F.length(text)
    starts = F.when(n == 0, F.array().cast("array<int>")).when(n <= BLOCK, F.array(F.lit(1))).otherwise(F.array_compact(F.array(n - BLOCK + 1, F.lit(1), F.when(n > 2 * BLOCK, F.lit(BLOCK + 1)))))

    def step(x: Column, start: Column) -> Column:
        rest = F.concat(F.substring(x, F.lit(1), start - 1), F.lit("."), F.substring(x, start + BLOCK, F.length(x)))
        own = F.when(F.length(x) <= BLOCK, tag).otherwise(F.concat(tag, F.lit("-"), start.cast("string"), F.lit("-"), rest, F.lit("-")))
        return F.concat(F.substring(x, F.lit(1), start - 1), _block(F.substring(x, start, F.lit(BLOCK)), base, own, key), F.substring(x, start + BLOCK, F.length(x)))

    return F.aggregate(starts, text, step)


def _block(text: Column, base: int, tag: Column, key: str) -> Column:
    """A string of BLOCK digits below `base` at most, permuted among those of its length."""
    n = F.length(text)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(float(base)), k).cast("decimal(38,0)").cast("long")
    number = lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0))
    both = _feistel(number(F.substring(text, F.lit(1), left)), number(F.substring(text, left + 1, n)), power(left), power(n - left), F.concat(tag, n.cast("string")), key)
    back = lambda v, k: F.when(k > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, "0")).otherwise("")
    return _with(both, lambda p: F.concat(back(p["a"], left), back(p["b"], n - left)))


#: Letters as digits of base 26.
_LETTERS, _AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _letters(x: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(x, "[^A-Za-z]", "")), _LETTERS, _AS_DIGITS)


def _fill(template: Column, digits: Column, letters: Column) -> Column:
    """The template with its digits replaced, in order, by `digits`, and its letters by `letters` in their own case."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("d"), F.lit(1).alias("l"))
    new = lambda s, text, d, l: F.struct(F.concat(s["text"], text).alias("text"), (s["d"] + d).alias("d"), (s["l"] + l).alias("l"))  # noqa: E731, E741

    def step(s, c):
        letter = F.translate(F.substring(letters, s["l"], F.lit(1)), _AS_DIGITS, _LETTERS)
        return F.when(c.rlike("[0-9]"), new(s, F.substring(digits, s["d"], F.lit(1)), 1, 0)).when(c.rlike("[a-z]"), new(s, letter, 0, 1)).when(c.rlike("[A-Z]"), new(s, F.upper(letter), 0, 1)).otherwise(new(s, c, 0, 0))

    return F.aggregate(F.regexp_extract_all(template, F.lit("(?s)."), F.lit(0)), start, step)["text"]


def _octets(x: Column) -> list[Column]:
    return [F.split(x, r"\.")[i].cast("long") for i in range(4)]


def _date(x: Column) -> Column:
    """A date as year-month-day, dotted with the day first or slashed with the month first; null if it is none."""
    day = F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "dd.MM.yyyy"), F.try_to_date(x, "MM/dd/yyyy"))
    return F.when(day.between(F.lit(EPOCH).cast("date"), F.lit("2199-12-31").cast("date")), day)


def kind(x: Column) -> Column:
    """What a match is, or null if it is no valid one of its kind."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    digits = _digits(x)
    area, group, serial = F.substring(x, 1, 3), F.substring(x, 5, 2), F.substring(x, 8, 4)
    day_first = F.try_to_date(x, "dd/MM/yyyy").between(F.lit(EPOCH).cast("date"), F.lit("2199-12-31").cast("date"))
    return (
        F.when(F.contains(x, F.lit("@")), F.lit("email"))
        .when(whole(PATTERNS["ip"]), F.when((F.greatest(*_octets(x)) <= 255) & ~x.rlike(r"(?:^|\.)0[0-9]"), F.lit("ip")))
        .when(whole(PATTERNS["date"]), F.when(_date(x).isNotNull(), F.lit("date")).when(day_first, F.when(F.startswith(x, F.lit("29/02")), F.lit("leap day")).otherwise(F.lit("day first"))))
        .when(whole(PATTERNS["ssn"]), F.when(~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), F.lit("ssn")))
        .when(whole(PATTERNS["card"]), F.when((_luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) + F.substring(digits, F.length(digits), F.lit(1)).cast("long")) % 10 == 0, F.when(digits.rlike("[1-9]"), F.lit("card"))))
        .when(whole(PATTERNS["iban"]), F.when((_mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1) & F.substring(x, 3, 2).between("02", "98"), F.lit("iban")))
        .when(whole(PATTERNS["phone"]), F.when(F.length(digits).between(8, 15), F.lit("phone")))
    )


def _by_kind(of: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(of == k, v) for k, v in values.items()])


def pseudonym(x: Column, of: Column, key: str) -> Column:
    """The stand-in of a match of that kind; a match without a kind stays."""
    o = _octets(x)
    day = F.datediff(_date(x), F.lit(EPOCH).cast("date")).cast("long")
    area, group, serial = (F.substring(x, s, n).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    year = F.substring(x, 7, 4).cast("long") - int(EPOCH[:4])
    before = [sum(_LATE[:m]) for m in range(12)]
    offsets = F.array(*[F.lit(n) for n in before])
    leaps = F.filter(F.sequence(F.lit(0), F.lit(399)), lambda y: F.try_to_date(F.concat(F.lit("29/02/"), (y + int(EPOCH[:4])).cast("string")), "dd/MM/yyyy").isNotNull())
    numbers = {
        "ip": (o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536),
        "date": (F.floor(day / DATE_MODULI[1]), day % DATE_MODULI[1], *DATE_MODULI),
        "day first": (year, F.element_at(offsets, F.substring(x, 4, 2).cast("int")) + F.substring(x, 1, 2).cast("long") - 13, 400, sum(_LATE)),
        "leap day": (F.lit(0), F.array_position(leaps, year.cast("int")) - 1, 1, 97),
        "ssn": ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, 898 * 99, 9999),
    }
    pair = _feistel(*[_by_kind(of, {k: v[i].cast("long") if i < 2 else F.lit(v[i]).cast("long") for k, v in numbers.items()}) for i in range(4)], of, key)

    def written(p: Column) -> Column:
        a, b = p["a"], p["b"]
        new = F.date_add(F.lit(EPOCH).cast("date"), (a * DATE_MODULI[1] + b).cast("int"))
        form = lambda f: F.date_format(new, f)
        late = F.size(F.filter(offsets, lambda n: n <= b))
        index = F.floor(a / 99)
        full = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return _by_kind(of, {
            "ip": F.concat_ws(".", *[v.cast("string") for h in (a, b) for v in (F.floor(h / 256), h % 256)]),
            "date": F.when(F.contains(x, F.lit("-")), form("yyyy-MM-dd")).when(F.contains(x, F.lit(".")), form("dd.MM.yyyy")).otherwise(form("MM/dd/yyyy")),
            "day first": F.concat_ws("/", full(b - F.element_at(offsets, late) + 13, 2), full(late, 2), full(a + int(EPOCH[:4]), 4)),
            "leap day": F.concat(F.lit("29/02/"), (F.element_at(leaps, (b + 1).cast("int")) + int(EPOCH[:4])).cast("string")),
            "ssn": F.concat_ws("-", full(index + 1 + F.when(index >= 665, 1).otherwise(0), 3), full(a % 99 + 1, 2), full(b + 1, 4)),
        })

    # A number's country code stays, or else its first digit: a leading 0 says what kind of number it is.
    code = F.regexp_extract(x, r"^(?:\+[0-9]{1,3}|\(?[0-9])", 0)
    local = F.substring_index(x, "@", 1)
    cut = _by_kind(of, {"iban": F.lit(4), "phone": F.length(code), "email": F.lit(0), "card": F.lit(0)})
    stem = F.when(of == "email", local).otherwise(F.substring(x, cut + 1, F.length(x)))

    def refilled(s: Column) -> Column:
        digits = _digits(s)
        digits = F.when(of == "card", F.substring(digits, F.lit(1), F.length(digits) - 1)).otherwise(digits)
        new = _string(digits, 10, of, key)
        new = F.when(of == "card", _with(new, lambda d: F.concat(d, F.pmod(-_luhn(d), F.lit(10)).cast("string")))).otherwise(new)
        filled = _fill(s, new, F.when(of.isin("iban", "email"), _string(_letters(s), 26, F.concat(of, F.lit("a")), key)).otherwise(""))
        return _with(filled, lambda t: F.when(of == "iban", F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(F.concat(t, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0"), t)).when(of == "email", F.concat(t, F.substring(x, F.length(local) + 1, F.length(x)))).when(of == "phone", F.concat(code, t)).otherwise(t))

    return F.when(of.isin(*numbers), _with(pair, written)).when(of.isin("iban", "email", "phone", "card"), _with(stem, refilled)).otherwise(x)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """docs with personal data in the text replaced, and count_col: how many places were. Whoever has the key can
    go back, so it is to be kept like a password.

    A text is cut at all matches and put together again around their stand-ins, so whatever isn't valid
    personal data stays as it was, byte for byte. A slashed date has the month first if it can. Null texts stay null with 0;
    empty ones empty. Rows are independent, so ties, repeats and null ids need no rule; all columns stay, and a column that is
    named as count_col is replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{text_col}`")
    n_found, n_kinds, n_new = fresh(docs, "found", "kinds", "new")
    asked = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    found = F.when(asked, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    has = docs.withColumn(n_found, found).withColumn(n_kinds, F.transform(n_found, kind))
    has = has.withColumn(n_new, F.zip_with(n_found, n_kinds, lambda x, k: F.when(k.isNull(), x).otherwise(pseudonym(x, k, key))))
    gaps = F.zip_with(F.split(text, ANY, -1), F.concat(n_new, F.array(F.lit(""))), lambda g, r: F.concat(g, r))
    n = F.coalesce(F.size(F.filter(n_kinds, lambda k: k.isNotNull())), F.lit(0))
    whole = F.when(F.coalesce(F.size(n_found), F.lit(0)) > 0, F.array_join(gaps, "")).otherwise(text)
    return has.withColumn(text_col, whole).withColumn(count_col, F.greatest(n, F.lit(0)).cast("long")).drop(n_found, n_kinds, n_new)
