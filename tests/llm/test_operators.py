"""The training-data operators against plain Python, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, embeddings, fill_in_middle, html_text, language_model, merkle, near_dup, packing, pii, relative_lz, simple8b, toxicity, urls
from folioflow.llm.queries import tokenizer_path
from folioflow.llm.tokens import Encoder

R = random.Random(3)
WORDS = ["".join(R.choices("abcdeéßx", k=R.randint(2, 6))) for _ in range(400)]
#: Columns that operators might name themselves.
CLASHES = "node component k __x bits piece key maybe wanted own gone part row found kinds new bad prints t1".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)


def prose(n, rng=R):
    return " ".join(rng.choices(WORDS, k=n))


def docs(spark, texts):
    rows = [(i, t, "en", "s", 0, *range(len(CLASHES))) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_match_the_library(name):
    from tokenizers import Tokenizer

    e, library = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    pool = list("aBcd 'st  \n\t.,!éÉßÀſİıŁ19%$&—’€\x1c\x85中文😀") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "'ll", "don't"]
    texts = ["".join(R.choices(pool[: R.randint(8, len(pool))], k=R.randint(1, 40))) for _ in range(3000)]
    for t in [*texts, "a <|endoftext|> b", "<|startoftext|>a", "<|endoftext|>", " <|endoftext|>\n"]:
        assert e.encode(t) == e.plain(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 60, 61, 255, 256, 257, 3000):
        for top in (1, 3, 300, 50000, 2**32 - 1, 2**60 - 1):
            ids = r.integers(0, top + 1, n, dtype=np.uint64)
            assert (simple8b.decode_ids(*simple8b.encode_ids(ids), n) == ids).all()
    with pytest.raises(ValueError):
        simple8b.encode_ids([1 << 60])


def test_token_files(spark):
    texts = [(5, "hello world"), (1, None), (None, "x"), (3, ""), (3, "again"), (9, "long " * 5000)]
    out = [r.asDict() for r in simple8b.read_token_files(simple8b.write_token_files(docs(spark, texts), tokenizer_path("word_bpe_49k.json"))).collect()]
    e, at = Encoder(tokenizer_path("word_bpe_49k.json")), 0
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), sorted(out, key=lambda r: r["start"])):
        ids = (e.plain(t) if t else b"") + (2).to_bytes(4, "little")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert simple8b.write_token_files(docs(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_is_whole(spark):
    texts = [(i, prose(R.randint(0, 900))) for i in range(60)] + [(7, "again"), (None, None), (61, ""), (62, prose(9000))]
    out = packing.pack(docs(spark, texts).repartition(3), tokenizer_path("byte_bpe_50k.json"), keep=3).collect()
    e = Encoder(tokenizer_path("byte_bpe_50k.json"))
    want = sum((len(e.plain(t)) // 4 if t else 0) + 1 for _, t in texts)
    assert sum(r.length for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
    assert sum(sum(r.length for r in s) < 2048 for s in sequences.values()) == 1
    for i, t in texts:
        if i not in (7, None):
            own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == (e.plain(t) if t else b"") + b"\x01\0\0\0"
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert packing.pack(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def near_copies(base, n, rng, share):
    for _ in range(n):
        w = base.split()
        for k in rng.sample(range(len(w)), max(1, int(len(w) * share))):
            w[k] = rng.choice(WORDS)
        yield " ".join(w)


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(keys[a]), find(keys[b])
                comp[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(R.randint(1, 120)) for _ in range(60)] + [None, "", "  \n", "one two", "ONE two", "É one"]
    for share in (0.01, 0.03, 0.05):
        base = prose(150, rng)
        texts += [base, base, *near_copies(base, 25, rng, share)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == want
    # A repeated id with other words is judged by its own text, one with the same text goes, and rows without an id stay.
    other = prose(80, rng)
    frame = docs(spark, texts + [(None, texts[3][1]), (0, other), (0, other), (2, texts[2][1])])
    left = near_dup.drop_duplicates(frame)
    kept = left.collect()
    assert left.columns == frame.columns and sum(r.doc_id is None for r in kept) == 1
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == sorted([(i, texts[i][1] or "") for i, (_, c) in want.items() if i == c] + [(0, other)])
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    """Copies of copies, in blocks of four members: buckets and components are cut, and nothing is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(6)
    base, texts = prose(120, rng), []
    for _ in range(40):
        base = next(near_copies(base, 1, rng, 0.02))
        texts += [base, *near_copies(base, 2, rng, 0.03)]
    texts.append("word " * 100_000 + prose(50, rng))
    texts = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_sets_that_share_a_hash_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5)]
    got = {r.doc_id: r.node for r in near_dup.apart(spark.createDataFrame(rows, "doc_id long, node long, check long")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8


def brute_overlap(text, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    ws, hit, found = split(text), set(), set()
    for i, t in items:
        iw = split(t)
        n = min(10, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1) if n else ():
            if tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found |= {str(i)} - {"None"}
    return len(ws), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(R.randint(8, 40))) for i in range(12)] + [(None, "no id two"), (20, "Solo"), (21, "two words"), (22, None), (23, ""), (24, "a " * 30)]
    texts = []
    for i in range(60):
        w = prose(R.randint(0, 80)).split()
        if i % 2:
            iw = R.choice(items[:12])[1].split()
            a = R.randint(0, len(iw) - 5)
            w[R.randint(0, len(w)) : 0] = [x.upper() if x.isascii() else x for x in iw[a : a + R.randint(5, 20)]]
        texts.append((i, ", ".join(w)))
    texts += [(90, None), (91, ""), (93, "There is NO id, two. No id; two"), (94, "w " * 60_000 + items[1][1]), (92, "solo. TWO-words!"), (92, "a " * 50), (None, items[0][1])]
    got = decontaminate.overlaps(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts)
    want = sorted(((i, *brute_overlap(t, items)) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == want
    left = decontaminate.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs(spark, []).columns
    clean = [(i, t) for i, t in texts if not brute_overlap(t, items)[1]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(clean, key=repr)
    twins = decontaminate.drop_contaminated(docs(spark, [(1, items[0][1]), (1, "clean text"), (2, None), (None, items[0][1])]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in twins.collect()), key=repr) == [(1, "clean text"), (2, None)]
    assert decontaminate.overlaps(docs(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


KEY = "a test's key"


def plain_feistel(a, b, of_a, of_b, tag, key=KEY, back=False):
    f = lambda i, x: int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in reversed(range(8)) if back else range(8):
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * f(i, b)) % of_a
        else:
            b = (b + sign * f(i, a)) % of_b
    return a, b


DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def in_base(v, base, n):
    out = ""
    for _ in range(n):
        v, r = divmod(v, base)
        out = DIGITS[r] + out
    return out


def plain_string(text, base, tag, back=False):
    """A string of digits permuted among those of its length, in blocks of 24 if it is longer."""
    def block(x, tag):
        left = len(x) // 2
        number = lambda s: int(s, base) if s else 0
        a, b = plain_feistel(number(x[:left]), number(x[left:]), base**left, base ** (len(x) - left), f"{tag}{len(x)}", back=back)
        return in_base(a, base, left) + in_base(b, base, len(x) - left)

    if not text:
        return ""
    if len(text) <= 24:
        return block(text, tag)
    starts = [len(text) - 23, 1] + ([25] if len(text) > 48 else [])
    for s in reversed(starts) if back else starts:
        head, own, tail = text[: s - 1], text[s - 1 : s + 23], text[s + 23 :]
        text = head + block(own, f"{tag}-{s}-{head}.{tail}-") + tail
    return text


def refill(template, digits, letters):
    d, w = iter(digits), iter(letters)
    return "".join(next(d) if c in "0123456789" else (chr(97 + DIGITS.index(next(w))).upper() if c.isupper() else chr(97 + DIGITS.index(next(w)))) if c.isascii() and c.isalpha() else c for c in template)


def plain_refill(text, tag, back=False):
    digits = "".join(c for c in text if c in "0123456789")
    letters = "".join(DIGITS[ord(c.lower()) - 97] for c in text if c.isascii() and c.isalpha())
    return refill(text, plain_string(digits, 10, tag, back), plain_string(letters, 26, tag + "a", back))


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def iban_check(country, body):
    return f"{98 - int(''.join(str(int(c, 36)) for c in (body + country + '00') if c != ' ')) % 97:02d}"


def plain_pseudonym(value, kind, back=False):
    """The stand-in of a valid value, or with `back` the value of a stand-in."""
    import datetime

    def dated(day, form):
        n = (day - datetime.date(1800, 1, 1)).days
        a, b = plain_feistel(n // 773, n % 773, 189, 773, "date", back=back)
        new = datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)
        return {"-": f"{new.year:04d}-{new.month:02d}-{new.day:02d}", ".": f"{new.day:02d}.{new.month:02d}.{new.year:04d}", "/": f"{new.month:02d}/{new.day:02d}/{new.year:04d}"}[form]

    if kind == "email":
        local, _, rest = value.partition("@")
        return plain_refill(local, "email", back) + "@" + rest
    if kind == "ip":
        o = list(map(int, value.split(".")))
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", back=back)
        return ".".join(map(str, (a // 256, a % 256, b // 256, b % 256)))
    if kind == "date":
        if "-" in value:
            return dated(datetime.date(*map(int, value.split("-"))), "-")
        if "." in value:
            return dated(datetime.date(*map(int, value.split(".")[::-1])), ".")
        x, y, year = map(int, value.split("/"))
        if x <= 12:
            return dated(datetime.date(year, x, y), "/")
        late = [19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19]
        if value.startswith("29/02"):
            leaps = [v for v in range(1800, 2200) if v % 4 == 0 and (v % 100 or v % 400 == 0)]
            _, b = plain_feistel(0, leaps.index(year), 1, 97, "leap day", back=back)
            return f"29/02/{leaps[b]}"
        a, b = plain_feistel(year - 1800, sum(late[: y - 1]) + x - 13, 400, 221, "day first", back=back)
        month = next(m for m in range(12) if b < sum(late[: m + 1]))
        return f"{b - sum(late[:month]) + 13:02d}/{month + 1:02d}/{a + 1800}"
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        a, b = plain_feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", back=back)
        return f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}|\(?[0-9]", value)[0]
        return code + plain_refill(value[len(code) :], "phone", back)
    if kind == "card":
        digits = [c for c in value if c.isdigit()]
        body = plain_string("".join(digits[:-1]), 10, "card", back)
        body += next(str(c) for c in range(10) if luhn(body + str(c)) == 0)
        return refill(value, body, "")
    body = plain_refill(value[4:], "iban", back)
    return value[:2] + iban_check(value[:2], body) + body


def personal(rng):
    """A valid value of every kind."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2030)
    body = digits(rng.choice([12, 14, 15, 18, 18]))
    yield "email", rng.choice(["Ann.Lee", "ANN.lee", "x", "j_doe99", "a-b+c.d1", "Katharina.Maria.Featherstonehaugh77"]) + digits(rng.randint(0, 3)) + "@mail.example.org"
    yield "ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))
    yield "date", rng.choice([f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}", f"{rng.randint(13, 28)}/{month:02d}/{year}", "29/02/2000", "29.02.1980"])
    yield "ssn", f"{rng.choice([rng.randint(1, 665), rng.randint(667, 899)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    yield "phone", rng.choice([f"+49 {digits(3)} {digits(4)} {digits(3)}", f"(415) 555-{digits(4)}", f"415-555-{digits(4)}", f"0171 {digits(4)}{digits(3)}", f"089/{digits(4)}-{digits(4)}"])
    number = "4" + digits(14)
    number += next(str(c) for c in range(10) if luhn(number + str(c)) == 0)
    yield "card", rng.choice([number, " ".join(number[i : i + 4] for i in range(0, 16, 4))])
    country = rng.choice(["DE", "GB", "NL"])
    body = rng.choice([body, "WEST" + digits(14), "ABNA" + digits(10)])
    whole = country + iban_check(country, body) + body
    yield "iban", rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])


def test_pseudonyms_against_brute_force(spark):
    rng = random.Random(4)
    values = [v for _ in range(60) for v in personal(rng)]
    texts = [(i, f"see {v}, then {v}!") for i, (_, v) in enumerate(values)]
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(docs(spark, texts), KEY).collect()}
    for i, (kind, v) in enumerate(values):
        new = plain_pseudonym(v, kind)
        assert got[i] == (f"see {new}, then {new}!", 2), (kind, v)
        assert plain_pseudonym(new, kind, back=True) == v, (kind, v)
    # Different values have different stand-ins.
    assert len({plain_pseudonym(v, k) for k, v in values}) == len({v for _, v in values})
    assert plain_pseudonym("Ann.Lee@x.org", "email") != plain_pseudonym("ann.lee@x.org", "email")


def test_pseudonyms_leave_the_rest(spark):
    invalid = "999.1.1.1 4111111111111112 1980-02-30 31.02.1999 000-12-3456 DE00370400440532013000 12:30 v1.2.3 2024"
    texts = [(1, invalid), (3, None), (4, ""), (5, "no data 12 here"), (None, "10.20.30.255"), (None, "10.20.30.255"), (6, "1.2.3.4 " + "word " * 50_000 + "1.2.3.4")]
    frame = docs(spark, texts)
    out = pii.pseudonymise(frame, KEY)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == invalid and rows[1].n_pii == 0 and rows[3].text is None and rows[4].text == "" and rows[5].text == "no data 12 here"
    new = plain_pseudonym("10.20.30.255", "ip")
    assert [r.text for r in out.where("doc_id IS NULL").collect()] == [new, new] and rows[1].found == CLASHES.index("found") and out.columns == [*frame.columns, "n_pii"]
    assert rows[6].text.startswith(plain_pseudonym("1.2.3.4", "ip") + " word") and rows[6].n_pii == 2
    assert len({plain_feistel(i // 773, i % 773, 189, 773, "date") for i in range(146097)}) == 146097
    assert pii.pseudonymise(docs(spark, []), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(frame, "")


def test_long_pseudonyms(spark):
    rng = random.Random(12)
    rows = []
    for n in range(25, 65):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
        rows += [(n, 36, text[:k] + ("a" if text[k] != "a" else "b") + text[k + 1 :]) for k in range(n)] + [(n, 36, text)]
    frame = spark.createDataFrame(rows, "n int, base int, text string").select("text", pii._string(F.col("text"), 36, F.lit("email"), "k").alias("new"))
    got = {r.text: r.new for r in frame.collect()}
    assert len(set(got.values())) == len(got) and all(len(a) == len(b) and re.fullmatch("[0-9a-z]+", b) for a, b in got.items())
    # No part stays in clear: places that agree are as many as by chance.
    agree = np.array([[x == y for x, y in zip(a[:25], b)] for a, b in got.items()]).mean(axis=0)
    assert agree.max() < 0.1
    bodies = ["".join(rng.choices("0123456789", k=29)) for _ in range(5)]
    bodies += [f"{i:05d}" + bodies[0][5:] for i in range(20)]
    ibans = [f"RU{98 - int(b + "273000") % 97:02d}{b}" for b in bodies]
    out = [r.text for r in pii.pseudonymise(docs(spark, list(enumerate(ibans))), KEY).orderBy("doc_id").collect()]
    assert len(set(out)) == len(set(ibans)) and all(re.fullmatch(r"RU[0-9]{31}", x) and int(x[4:] + "2730" + x[2:4]) % 97 == 1 for x in out)
    mail = pii.pseudonymise(docs(spark, [(1, "katharina.maria.featherstonehaughsmith@x.org")]), KEY).first().text
    assert "katharina" not in mail and re.fullmatch(r"[a-z]{9}\.[a-z]{5}\.[a-z]{22}@x\.org", mail)


def test_main_text():
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/a">menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; tail</h1><p><b>One<br>two.<br><p>Long  text\n here &lt;b&gt; and more words to read.</p><aside>side</aside><p>Short.</p><div class="comments"><p>me too</p></div></article><footer>&copy; x</footer></body></html>'
    assert html_text.main_text(page) == "Head & tail\nOne two.\nLong text here <b> and more words to read.\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    bare = "<body><div id='menu'><a>x</a></div>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5)) + "<div><a>1</a><a>2</a><a>3</a></div></body><foo"
    assert html_text.main_text(bare).count("\n") == 4


def test_marked_elements_come_back_if_they_hold_the_text(spark):
    body = "<p>" + "Many words of a story in a row. " * 8 + "</p>"
    for page in (f'<body><div class="article-body side-story">{body}<div class="comments"><p>me too</p></div></div></body>', f'<article><div class="comment-free">{body}</div></article>', f"<article><form>{body}</form></article>"):
        assert html_text.main_text(page) == ("Many words of a story in a row. " * 8).strip()
    assert html_text.main_text('<article><p>Short text.</p></article><footer>' + "Notes of the house in a long line. " * 3 + "</footer>") == "Short text."
    pages = [(1, "u", body), (1, "u", body), (None, None, None), (2, "u", ""), (3, "u", "<div>" * 3000 + "x</b></li>" * 3000), (4, "u", f"<article>{body * 2000}</article>")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract_text(frame).collect())
    assert got == sorted((i or 0, html_text.main_text(h)) for i, _, h in pages) and got[-1][1].count("\n") == 1999
    assert html_text.extract_text(frame.limit(0)).count() == 0


def test_main_text_by_ratio():
    body = [f"Paragraph {i} of the story, " + "with many words in a row " * 6 for i in range(6)]
    story = "<h1>The story</h1>" + "".join(f"<p>{t.strip()}</p>" for t in body)
    want = "\n".join(["The story", *[t.strip() for t in body]])
    cards = "".join(f'<article><h2><a href="/{i}">Other {i}</a></h2><p><a href="/{i}">Read it</a></p></article>' for i in range(8))
    assert html_text.main_text(f"<body><div>{story}</div><div>{cards}</div></body>") == want
    links = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12)) + "</ul>"
    assert html_text.main_text(f"<body><main>{links}<div>{story}<ul><li>One</li><li>Two</li></ul></div>{links}</main></body>") == want + "\nOne\nTwo"


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        w = prose(rng.randint(5, 40), rng).split()
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "vile"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(None, None), (1000, "")]
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(labels[i][1]) for i in held]) > 0.95
    left = {r.doc_id for r in toxicity.drop_toxic(table, model).collect()}
    assert 1000 in left and len(left & {i for i, y in labels if y}) < 20
    none = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(table, none).where("score >= 0.5 OR rejected").count() == 0
    # The forward pass from its formula, on texts shorter than a window, long ones and none.
    for text in ["", "idiot", "a vile thing", prose(9000, rng), rows[3][1]]:
        ids = [zlib.crc32(w.encode()) % toxicity.BUCKETS for w in re.findall(r"[^\W_]+", text.lower())] or [toxicity.BUCKETS]
        vectors = [model.embedding[i] for i in ids] + [np.zeros(toxicity.DIMS)] * 2
        pooled = [max(0.0, *[float(sum(vectors[k + j] @ f[j][:, c] for j in range(len(f)))) for k in range(len(ids))]) for f in model.filters for c in range(toxicity.FILTERS)]
        want = 1 / (1 + math.exp(-(float(np.dot(pooled, model.out)) + model.bias)))
        assert abs(toxicity.score(docs(spark, [(1, text)]), model).first().score - want) < 1e-4
    # A language's threshold has the fewest errors over all labelled rows, counted here one by one.
    shared = spark.createDataFrame([(k, f"t{k}", "en" if k % 2 else "de") for k in range(400)], "k long, text string, lang string")
    known = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(400)], "k long, y int")
    overall, by_lang = toxicity.calibrated(shared, known, [model], {})
    scores = {r.doc_id: r.score for r in toxicity.score(shared.withColumnRenamed("k", "doc_id"), model).collect()}
    wrong = lambda cut, own: sum((int(scores[k] * toxicity.BINS) >= cut) != (k % 7 == 0) for k in own)
    cuts = range(1, toxicity.BINS)
    assert overall == min(cuts, key=lambda b: (wrong(b, range(400)), abs(b - 50))) / 100
    for lang, first in (("en", 1), ("de", 0)):
        assert by_lang[lang] == min(cuts, key=lambda b: (wrong(b, range(first, 400, 2)) + toxicity.PRIOR_ROWS * wrong(b, range(400)) / 400, abs(b - 50))) / 100
    assert toxicity.score(docs(spark, []), model).count() == 0 and toxicity.drop_toxic(docs(spark, []), model).count() == 0


def test_toxicity_of_rare_endings_and_shared_buckets(spark):
    """A toxic word that shares its bucket with a common one is told apart, and so are words of one stem that occur once each."""
    rng = random.Random(11)
    at = lambda w: zlib.crc32(w.encode()) % toxicity.BUCKETS
    common = "".join(rng.choice("abcde") for _ in range(9))
    toxic = next(w for i in range(10**6) if at(w := f"zork{i}") == at(common))
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.2
        w = prose(rng.randint(10, 40), rng).split() + [common]
        if bad:
            w.insert(rng.randint(0, len(w)), toxic if i % 2 else "grumpf" + "".join(rng.choice("aeioulmnrst") for _ in range(8)))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    for kind in (0, 1):
        own = [got[i] for i, y in held if y and i % 2 == kind]
        assert len(own) > 10 and np.mean([r.score >= 0.5 for r in own]) > 0.95 and np.mean([r.rejected for r in own]) > 0.95
    assert np.mean([got[i].rejected for i, y in held if not y]) < 0.02


def test_marks(spark):
    """Counted here one by one: of all rows, and of either half. A beginning counts words that are no marks."""
    rng = random.Random(5)
    rows = [(i, f"{rng.choice('abc')}xx {'vile vilest' if i % 4 == 0 else ''} {'mur' + chr(97 + i % 26) * 3 if i % 4 == 1 else 'plain'}", int(i % 4 < 2), i // 4 % 2) for i in range(400)]
    got = toxicity.marks_of(spark.createDataFrame([*rows, (400, None, 0, 0)], "k long, text string, y int, half int"))
    for marks in got:
        whole = {m[:-1] for m in marks if isinstance(m, str) and m[-1] == " "}
        starts = {m for m in marks if isinstance(m, str) and m[-1] != " "}
        assert whole == {"vile", "vilest"} and starts == {"mur"}
        assert toxicity.row_of("vile", marks) == toxicity.crc32(b"vile") % toxicity.BUCKETS
        assert toxicity.row_of("murzz", marks) == marks["mur"] > toxicity.BUCKETS
        assert toxicity.row_of("villa", marks) == toxicity.crc32(b"villa") % toxicity.BUCKETS
    # Two words of one bucket: the surer has it, the other a row behind, and no third one gets in.
    at = lambda w: zlib.crc32(w.encode()) % toxicity.BUCKETS
    second, third = [w for i in range(200_000) if at(w := f"w{i}") == at("vile")][:2]
    marks = toxicity.placed(["vile", second], [])
    assert [toxicity.row_of(w, marks) for w in ("vile", second, third)] == [at("vile"), toxicity.BUCKETS + 2, toxicity.BUCKETS]


def plain_kneser_ney(texts):
    """The probability of a five-character gram's last character: interpolated modified Kneser-Ney, from the formulas."""
    from collections import Counter, defaultdict

    counts = {5: Counter(p[i : i + 5] for p in ("\uffff" * 4 + t for t in texts) for i in range(len(p) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals = {}, {}
    for k, c in counts.items():
        n = [0] + [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [0] + [min(i, max(0.05 * i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
        totals[k] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            totals[k][g[:-1]][0] += v
            totals[k][g[:-1]][1] += cuts[k][min(v, 3)]

    def p(g, base):
        if not g:
            return base
        v, (total, cut) = counts[len(g)][g], totals[len(g)].get(g[:-1], (0, 0))
        return (v - cuts[len(g)][min(v, 3)]) / total + cut / total * p(g[1:], base) if total else p(g[1:], base)

    return p


def test_language_model_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, prose(60, rng)) for i in range(80)] + [(80 + i, " ".join(w + "%%$" for w in prose(60, rng).split())) for i in range(20)]
    rows += [(300 + i, prose(rng.randint(1, 10), rng)) for i in range(20)] + [(200, None), (201, ""), (None, "x\x00\x00y"), (5, prose(61, rng)), (205, "again"), (205, "again"), (202, "".join(map(chr, range(0x4E00, 0x4E00 + 8000)))), (203, prose(20000, rng))]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1, 1), (None, 1), (85, 0), (86, None)], "doc_id long, quality int")
    table = docs(spark, rows)
    got = language_model.judge(table.repartition(3), labels).collect()
    fold = {r.doc_id: r.fold for r in table.select("doc_id", language_model.fold(F.col("doc_id")).alias("fold")).collect()}
    good = [(i, t) for i, t in rows if i is not None and i < 60]
    models = [plain_kneser_ney([t for i, t in good if fold[i] != f]) for f in range(language_model.FOLDS)]
    base = 1 / (len({c for _, t in good for c in t}) + 1)
    want = {}
    for i, t in rows:
        p = "\uffff" * 4 + (t or "")
        logs = [math.log(models[fold[i]](p[k : k + 5], base)) for k in range(len(t or ""))]
        want[i, len(t or "")] = math.exp(-sum(logs) / len(logs)) if logs else None
    assert len(got) == len(rows)
    bounds = []
    for i, t in rows:
        near = [r for r in got if r.doc_id == i and (r.perplexity is None) == (not t) and (not t or abs(r.perplexity / want[i, len(t)] - 1) < 1e-3)]
        assert near, (i, t)
        if i is not None and i < 60:
            bounds.append(want[i, len(t)] * math.exp(-2 / math.sqrt(len(t))))
    assert {r.threshold for r in got} == {got[0].threshold} and abs(got[0].threshold / max(bounds) - 1) < 1e-3
    assert all(r.kept == (r.perplexity is not None and r.bound <= r.threshold) for r in got)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].kept for i in range(60, 80)) >= 18 and not any(by[80 + i].kept for i in range(20)) and not by[200].kept and not by[201].kept
    none = language_model.judge(docs(spark, rows[:3]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.kept and r.threshold is None for r in none)
    assert language_model.judge(docs(spark, []), labels).count() == 0


def test_language_model_sees_real_characters(spark):
    rng = random.Random(10)
    cyrillic = str.maketrans("abcdeéßx", "абвгдежз")
    good = [(i, prose(60, rng).translate(cyrillic)) for i in range(80)]
    junk = [(100 + i, "".join(rng.choice("αβγδ中文字号ウエ") if c != " " else c for c in prose(60, rng))) for i in range(20)]
    table = docs(spark, good + junk)
    got = {r.doc_id: r for r in language_model.judge(table, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert sum(got[i].kept for i in range(60, 80)) >= 15 and not any(got[100 + i].kept for i in range(20))
    small, large = (language_model.sharded(docs(spark, good[:n]).select("text", F.lit(0).alias("part")))[0][-1][0].count() for n in (20, 60))
    assert large > small
    # Probabilities after any context sum to one over the characters and the unseen one.
    tables, base = language_model.sharded(docs(spark, [(1, "abcabcabd"), (2, "abcab")]).select("text", F.lit(1).alias("part")))
    ask = spark.createDataFrame([(c + x,) for c in ("cabc", "zzab") for x in "abcd?"], "gram string")
    p = {r.gram: r.p0 for r in language_model.answers(ask, tables, base).collect()}
    assert all(abs(sum(v for g, v in p.items() if g.startswith(c)) - 1) < 1e-9 for c in ("cabc", "zzab"))


def test_urls(spark):
    link = lambda h: f'<a class="x" href="https://{h}/p">t</a>'
    rows = [
        (1, "HTTP://A.NET/x?q=1", None), (2, "https://b.example.net/en/1#t", link("good.info")), (3, "https://x.example.com/de/3", ""), (4, "https://x.org/fr/", link("good.info")),
        (5, "https://good.info/a", ""), (6, "https://bad.info/a", link("a.net") + link("spam.net")), (7, None, None), (8, "nothing", ""), (9, "https://org", ""), (9, "https://org", ""), (None, "https://notnet/", ""),
    ]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.net", "/x", "net/", "block") and by[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert by[3][2:] == ("example.com/de/", "block") and by[4][2:] == ("org/fr/", "allow") and by[5][2:] == (None, "allow")
    assert by[6][2:] == (None, "block") and by[7] == by[8] == ("", "", None, "allow") and by[9] == ("org", "", None, "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_spread_against_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(a, b): rng.randint(1, 4) for a, b in (rng.sample(hosts, 2) for _ in range(90))}
    seeds = {h: rng.random() for h in hosts[:6]}
    total = {b: sum(n for (_, y), n in edges.items() if y == b) for _, b in edges}
    level, received = dict(seeds), {}
    for _ in range(urls.ITERATIONS):
        received = {b: urls.DAMPING * sum(n / total[b] * level.get(a, 0) for (a, y), n in edges.items() if y == b) for b in total}
        level = {h: max(seeds.get(h, 0), received.get(h, 0)) for h in hosts}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r.host: r.received for r in urls.spread(frame, spark.createDataFrame(list(seeds.items()), "host string, weight double")).collect()}
    assert all(abs(got.get(h, 0) - v) < 1e-9 for h, v in received.items()) and set(got) <= set(received)


def test_distrust_does_not_shrink_with_the_graph(spark):
    edges = spark.createDataFrame([("s1", "farm", 1), ("s1", "mixed", 1), ("good", "mixed", 3), ("farm", "second", 2)], "src string, dst string, n long")
    want = {"farm": 0.85, "mixed": 0.2125, "second": 0.7225}
    for n in (10, 1_000_000):
        seeds = spark.range(n).select(F.concat(F.lit("s"), "id").alias("host"), F.lit(1.0).alias("weight"))
        got = {r.host: r.received for r in urls.spread(edges, seeds).collect()}
        assert got.keys() == want.keys() and all(abs(got[h] - v) < 1e-9 for h, v in want.items())
    hub = spark.range(100_000).select(F.lit("s1").alias("src"), F.concat(F.lit("h"), "id").alias("dst"), F.lit(1).cast("long").alias("n"))
    assert urls.spread(hub, seeds).agg(F.min("received")).first()[0] >= 0.85


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 32))
    rows = [v for v in base] + [v + r.normal(size=32) * s for v in base[:12] for s in (0.01, 0.1, 0.3, 0.4)] + [base[3], base[3] * 2, base[3]]
    rows = [[float(np.float32(x)) for x in v] for v in rows] + [None, [], [0.0] * 32, [None] * 32, [math.nan] * 32, [1.0, 2.0], [1.0, 2.0]]
    want = {}
    arr = [np.array(v) if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for v in rows]
    link = [{j for j, y in enumerate(arr) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9} for i, x in enumerate(arr)]
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(link[i]), min(seen))
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit(2))
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(table).collect()}
    assert got == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# Operators 11 to 13: rows with null and repeated ids, equal rows, null and empty texts, clashing columns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_merkle(rows, fan):
    """Per row (id, leaf, subroot, root, siblings) of (id, group, leaf), by walking every tree."""

    def climb(level):
        steps = [[] for _ in level]
        own = list(range(len(level)))
        while len(level) > 1:
            for k, at in enumerate(own):
                run = level[at - at % fan : at - at % fan + fan]
                steps[k] += run[: at % fan] + run[at % fan + 1 :]
            level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
            own = [at // fan for at in own]
        return level[0], steps

    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    tops = [climb([r[2] for r in g]) for g in groups.values()]
    root, over = climb([t for t, _ in tops])
    return sorted((str(r[0]), r[2], top, root, sha("".join(steps[k] + above))) for g, (top, steps), above in zip(groups.values(), tops, over) for k, r in enumerate(g))


@pytest.mark.parametrize("fan", [2, 3])
def test_merkle_against_brute_force(spark, fan):
    rng = random.Random(fan)
    rows = [(i, rng.choice(["a\nb", "", None, "é\n\n", "x" * 5000]), rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", "S", "", None, "ü", "-"]), rng.choice([1, None])) for i in [*range(70), None, None, 5, 5, -3]]
    rows += [(9, "same", "en", "s1", 1)] * 3 + [(1000, "alone", "en", "only", 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp int, node string, idx int")

    def leaf(r, cut=False):
        text = r[1].replace("\n", "") if cut and r[1] is not None else r[1]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    found = merkle.manifest(frame, {"later": merkle.leaf(*cut)}, fan=fan)
    hexed = [merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    out = found.select("doc_id", *hexed, F.sha2(merkle.hex_text(merkle.proof(F.col("path"))), 256).alias("proof"), merkle.hex_text(merkle.fold(F.col("leaf"), F.col("path"))).alias("folded"), merkle.hex_text(merkle.fold(F.col("later"), F.col("path"))).alias("later")).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in out) == brute_merkle([(r[0], r[3], leaf(r)) for r in rows], fan)
    assert all(r.folded == r.root for r in out)
    changed = {leaf(r) for r in rows if leaf(r) != leaf(r, True)}
    assert changed and all((r.later == r.root) == (r.leaf not in changed) for r in out)
    assert merkle.manifest(frame.limit(0)).count() == 0
    lone = merkle.manifest(frame.where("doc_id = 1000")).collect()[0]
    assert lone.leaf == lone.subroot == lone.root and lone.path == []


def test_merkle_deals_a_hot_group_out(spark):
    """Leaves of one group lie in several partitions, and are numbered without gaps."""
    frame = spark.range(3000).select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"))
    placed = merkle._ranked(frame, [F.col("id").asc_nulls_first(), F.col("node").asc()])
    assert sorted(r.idx for r in placed.collect()) == list(range(3000)) and {r.members for r in placed.collect()} == {3000}
    assert [r.node for r in placed.orderBy("idx").collect()] == sorted(r.node for r in placed.collect())


def test_fill_in_middle_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "CHUNK", 7)
    tricky = ["", None, "<", "<P", "a<S", "x<P>y", "<<<<SSS>>>", "é中😀" * 9, "a", "<S" * 30, "long " * 3000, "<M>", "\n\t "]
    texts = [(i, tricky[i % len(tricky)]) for i in range(260)] + [(None, "no id"), (None, "no id"), (4, "again"), (4, "again"), (4, None)]
    frame = docs(spark, texts).repartition(3)

    def want(i, t):
        t = t or ""
        h = [int(sha(f"1:{'' if i is None else i}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted(x % (len(t) + 1) for x in h[:2])
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            return "plain", None, None, t
        if h[3] % 100 < 20:
            return "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        return "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"

    rows = [(str(i), len(t or ""), *want(i, t), t or "") for i, t in texts]
    got = fill_in_middle.digests(frame).collect()
    assert sorted(map(str, ((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got))) == sorted(map(str, ((*r[:5], sha(r[5]), sha(r[6])) for r in rows)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    outputs = fill_in_middle.assembled(fill_in_middle.pieces(frame))
    assert sorted((str(r.doc_id), r.text) for r in fill_in_middle.texts(outputs).collect()) == sorted((r[0], r[5]) for r in rows)
    assert sorted((str(r.doc_id), r.text) for r in fill_in_middle.texts(fill_in_middle.restored(outputs)).collect()) == sorted((r[0], r[6]) for r in rows)
    assert fill_in_middle.digests(docs(spark, [])).count() == 0


def brute_repeats(texts):
    """(n_words, kept) per text in the order of the documents: every window of 20 words against all before it."""
    seen, out = set(), []
    for _, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        out.append((len(words), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("remembered", [1, 50, 200_000])
def test_relative_lz_against_brute_force(spark, monkeypatch, remembered):
    monkeypatch.setattr(relative_lz, "REMEMBERED", remembered)
    rng = random.Random(remembered)
    passage, border = prose(60, rng), prose(20, rng)
    texts = []
    for i in range(160):
        parts = [prose(rng.randint(0, 40), rng)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice([passage, border, texts[rng.randrange(len(texts))][1] if texts else border]).split()
            a = rng.randrange(max(1, len(w) - 15))
            parts += [" ".join(w[a : a + rng.choice([19, 20, 21, 35, 200])]), prose(rng.randint(0, 3), rng)]
        texts.append((i, rng.choice([" ", "\n ", "\t"]).join(parts)))
    texts += [(200, "a " * 300), (201, "b " + "a " * 40), (202, "a b " * 100), (203, None), (204, ""), (205, "\x1c \x85 \u3000"), (206, texts[3][1]), (207, "one " * 19), (208, "one " * 20), (209, "two " * 21)]
    texts = [(None, prose(30, rng)), (None, texts[5][1])] + texts
    got = relative_lz.deduplicate(docs(spark, texts).repartition(5)).collect()
    for order in (texts, [texts[1], texts[0], *texts[2:]]):  # rows without an id have no order among themselves
        want = sorted(zip((str(i) for i, _ in order), brute_repeats(order)), key=str)
        if want == sorted(((str(r.doc_id), (r.n_words, r.kept)) for r in got), key=str):
            break
    assert sorted(((str(r.doc_id), (r.n_words, r.kept)) for r in got), key=str) == want
    of = {i: (t or "").split() if i != 205 else [] for i, t in texts if i is not None}
    for r in got:
        assert r.n_removed == r.n_words - len(r.kept.split(" ")) * bool(r.kept)
        for f in r.factors if r.doc_id is not None else ():
            assert f.length >= 20 and (f.source is None or (f.source, f.source_start) < (r.doc_id, f.start))
            if f.source is not None:
                assert of[f.source][f.source_start : f.source_start + f.length] == of[r.doc_id][f.start : f.start + f.length]
    assert relative_lz.deduplicate(docs(spark, [])).count() == 0


def test_relative_lz_repeated_rows(spark):
    """Rows of one id are documents one after another: one of equal rows stays."""
    base = prose(50)
    got = relative_lz.deduplicate(docs(spark, [(1, base)] * 4 + [(2, base), (None, base + " tail")]).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 50)] * 4 + [("2", 50), ("None", 0)]


def test_index_stream_is_the_same_in_any_batches():
    """What _parsed hands on doesn't depend on where batches end."""
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(9), k, rng.randrange(5) << 32 | 7, None, None) for k in range(200))
    rows += [(3, 0, 1, 900, 5 << 32 | 6, 4, 2)]
    rows.sort(key=lambda r: r[:5])

    def run(size):
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], names=list("abcdefg")) for k in range(0, len(rows), size)]
        return sorted(str(r) for b in relative_lz._parsed(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns]))

    whole = run(1000)
    assert all(run(n) == whole for n in (1, 2, 3, 7, 50))
    firsts, grams = {}, {}
    for g, i, d, r, s, src, at in rows:
        if at is None:
            grams.setdefault(g, set()).add(i)
            firsts.setdefault((g, i), (d, s >> 32, r))
    want = [(None, r, s, *firsts[g, i][:2]) for g, i, d, r, s, _, at in rows if at is None and firsts[g, i][2] != r]
    want += [(g, r, s, None, None) for g, i, d, r, s, _, at in rows if at is None and firsts[g, i][2] == r and len(grams[g]) > 1] + [(None, 900, 5 << 32 | 6, 4, 2)]
    assert whole == sorted(map(str, want))
