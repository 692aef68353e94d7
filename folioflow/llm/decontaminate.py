"""Benchmark decontamination by winnowing (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import split_maybe
from .common import ascii_lower, fresh, stored

#: Words of a window that counts as shared, words of a fingerprinted gram, grams that one minimum stands for.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: A fingerprint is a long: 33 bits of the gram's hash above its position, which no array's length can exceed. Grams
#: whose hashes agree by chance are told apart when the meeting is extended.
POSITION = (1 << 31) - 1
#: Bytes of benchmark fingerprints up to which they are broadcast; beyond, the joins shuffle, and a fingerprint that
#: very many texts share is dealt out to SALTS tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 16


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(hashes: Column, size: int) -> Column:
    """Hash and position of every run of `size` words, from the words' hashes."""
    high = F.lit(~POSITION)
    hashed = lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]).bitwiseAND(high).bitwiseOR(i.cast("long"))
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), hashed)).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column) -> Column:
    """The least gram of every window, each once: the leftmost of equals."""
    low = F.transform(F.sequence(F.lit(0), F.size(grams) - WINDOW), lambda i: F.least(*[F.get(grams, i + k) for k in range(WINDOW)]))
    return F.when(F.size(grams) >= WINDOW, F.array_distinct(low)).otherwise(F.array().cast("array<bigint>"))


def benchmark_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(print, item_at, item_id, item_words, span): winnowed fingerprints of items of SPAN words or more; a
    shorter item is one fingerprint of its whole length. Items without words have none."""
    ws = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), words(F.col(f"`{text_col}`")).alias("item_words")).where("size(item_words) > 0")
    ws = ws.withColumn("hashes", F.transform("item_words", lambda w: F.xxhash64(w)))
    ws = ws.withColumn("grams", _grams(F.col("hashes"), GRAM))
    short = [F.when(F.size("item_words") == n, _grams(F.col("hashes"), n)) for n in range(1, SPAN)]
    marks = ws.select("item_id", "item_words", F.explode_outer(F.coalesce(*short, _minima(F.col("grams")))).alias("v")).where("v IS NOT NULL")
    return marks.select(
        F.col("v").bitwiseAND(F.lit(~POSITION)).alias("print"), F.col("v").bitwiseAND(F.lit(POSITION)).cast("int").alias("item_at"),
        "item_id", "item_words", F.least(F.size("item_words"), F.lit(SPAN)).alias("span"),
    )


def _printed(rows: DataFrame, least: list[int]) -> DataFrame:
    """rows with the hashes of their words `ws`, and their fingerprints `prints`: winnowed, and all of the short lengths.

    Explode them as explode_outer: for a plain explode Spark puts a filter on their number below these columns, with
    all of their expressions written into one another, so that every gram would hash the whole text again.
    """
    rows = rows.withColumn("hashes", F.transform("ws", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("grams", _grams(F.col("hashes"), GRAM))
    return rows.withColumn("prints", F.concat(_minima(F.col("grams")), *[_grams(F.col("hashes"), n) for n in least]))


def _met(rows: DataFrame, marks: DataFrame, own: str, small: bool, how: str) -> DataFrame:
    """rows joined with marks by their print; `own` tells rows of one print apart."""
    if small:
        return rows.join(F.broadcast(marks), "print", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(own, "print"), F.lit(SALTS)).cast("int"))
    return salted.join(marks.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), ["print", "salt"], how).drop("salt")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, hit_windows (array of start and length), item_ids (array), n_hit.

    A run of SPAN words that a document shares with an item holds a whole window of grams, whose minimum is
    the same gram on both sides; so the join of fingerprints finds every such run, and each meeting is
    extended word by word over all windows around it, which confirms or refutes it. Items shorter than SPAN
    words are met at their full length. A first pass joins bare fingerprints and keeps the hashes of texts that meet
    any; only texts that may be among them are cut up again, with the words around each fingerprint. Nothing is matched on
    ids: repeated rows and null ids keep a result each; null and empty texts have no words; null item ids are
    hit but not listed. Other columns are ignored. The benchmark is broadcast only while BROADCAST_BYTES hold it.
    """
    marks = stored(benchmark_prints(items), "prints")
    size, least = marks.agg(F.sum(F.length(F.concat_ws(" ", "item_words")) + 24 * F.size("item_words") + 64), F.collect_set(F.when(F.col("span") < SPAN, F.col("span")))).first()
    small, least = (size or 0) <= BROADCAST_BYTES, sorted(least)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.struct(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")))
    bare = _printed(rows.select("key", words(F.col("text")).alias("ws")), least).select("key", F.explode_outer("prints").alias("v")).where("v IS NOT NULL")
    bare = bare.select("key", F.col("v").bitwiseAND(F.lit(~POSITION)).alias("print"))
    known = marks.select("print").distinct()
    met = stored(_met(bare, known, "key", small, "inner").select("key").distinct(), "met")
    sure, maybe = split_maybe(rows, "key", met)
    spans = "array<struct<start:int,length:int>>"
    clean = sure.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.array().cast(spans).alias("hit_windows"), F.array().cast("array<string>").alias("item_ids"))

    found = maybe.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws"))
    found = _printed(found, least)
    at = lambda v: v.bitwiseAND(F.lit(POSITION)).cast("int")
    first = lambda v: F.greatest(at(v) - (WINDOW - 1), F.lit(0))
    pieces = F.transform("prints", lambda v: F.struct(v.alias("v"), F.slice("ws", first(v) + 1, SPAN + WINDOW - 1).alias("near")))
    # A piece without a fingerprint stays in any case, so rows without a hit come out too.
    marker = F.array(F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("array<string>").alias("near")))
    seen = found.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), F.explode_outer(F.concat(pieces, marker)).alias("p"))
    seen = seen.select("row", "doc_id", "n_words", F.col("p.v").bitwiseAND(F.lit(~POSITION)).alias("print"), at(F.col("p.v")).alias("at"), first(F.col("p.v")).alias("first"), "p.near")
    hits = _met(seen, marks, "row", small, "left").where("item_words IS NOT NULL OR at IS NULL")
    shifts = F.sequence(-F.least(F.lit(WINDOW - 1), F.col("at"), F.col("item_at")), F.lit(0))
    same = lambda d: (F.col("item_at") + d + F.col("span") <= F.size("item_words")) & (F.slice("near", F.col("at") + d - F.col("first") + 1, F.col("span")) == F.slice("item_words", F.col("item_at") + d + 1, F.col("span")))
    starts = F.when(F.col("at").isNotNull(), F.transform(F.filter(shifts, same), lambda d: F.struct((F.col("at") + d).alias("start"), F.col("span").alias("length"))))
    hits = hits.select("row", "doc_id", "n_words", F.when(F.size(starts) > 0, F.col("item_id")).alias("item_id"), F.explode_outer(starts).alias("window"))
    per = hits.groupBy("row", "doc_id", "n_words").agg(F.collect_set("window").alias("hit_windows"), F.collect_set("item_id").alias("item_ids"))
    both = clean.unionByName(per.select("doc_id", "n_words", F.col("hit_windows").cast(spans), F.array_sort("item_ids").alias("item_ids")))
    covered = F.array_distinct(F.flatten(F.transform("hit_windows", lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1))))
    return both.select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), "hit_windows", "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that share a window with an item; every other row as it was, with all its columns.

    A row is judged by its own text, whatever its id: rows that share an id, or have none, stay or go one by one, and rows
    of the same text together. Null and empty texts stay; no rows give no rows.
    """
    own, bad_key = fresh(docs, "key", "bad")
    keyed = docs.withColumn(own, F.sha2(F.col(f"`{text_col}`").cast("string"), 256))
    bad = stored(overlaps(keyed, items, own, text_col).where("n_hit > 0").select("doc_id").distinct(), "contaminated")
    sure, maybe = split_maybe(keyed, own, bad)
    rest = maybe.join(bad.select(F.col("doc_id").alias(bad_key)), F.col(own) == F.col(bad_key), "left_anti")
    return sure.unionByName(rest).drop(own)
