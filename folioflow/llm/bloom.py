"""A fixed-size filter that keeps most rows whose key isn't wanted out of a shuffle; an exact join follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The filter has 2**BITS bits in pieces of 32,768: 8 MB however many keys there are. Beyond some ten
#: million keys it lets ever more rows through, which costs time and changes no result.
BITS = 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def _marked(rows: DataFrame, key: str, wanted: DataFrame, mark: str) -> DataFrame:
    """rows with a boolean `mark`: whether their key may be among those in wanted's first column. Null keys never are."""
    place = _place(F.col("k"))
    piece, bits = fresh(rows, "piece", "bits")
    keys = wanted.select(F.col(f"`{wanted.columns[0]}`").alias("k")).where("k IS NOT NULL")
    pieces = keys.select(F.shiftright(place, 15).alias(piece), (place % 32768).alias("bit")).groupBy(piece).agg(F.expr("bitmap_construct_agg(bit)").alias(bits))
    own = F.col(f"`{key}`")
    here = _place(own)
    byte = F.conv(F.hex(F.substring(bits, F.floor(here % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2), here % 8)) % 2 == 1, F.lit(False)) & own.isNotNull()
    return rows.join(F.broadcast(pieces), F.shiftright(here, 15) == F.col(piece), "left").withColumn(mark, bit).drop(piece, bits)


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among the keys in wanted's first column: all that are, and few others."""
    (mark,) = fresh(rows, "maybe")
    return _marked(rows, key, wanted, mark).where(F.col(mark)).drop(mark)


def members(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the keys in wanted's first column, each once. An inner join with distinct keys:
    Spark would push a semi-join below the filter and shuffle every row."""
    (want,) = fresh(rows, "wanted")
    ids = wanted.select(F.col(f"`{wanted.columns[0]}`").alias(want)).distinct()
    return maybe_in(rows, key, wanted).join(ids, F.col(f"`{key}`") == F.col(want)).drop(want)


def split_maybe(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surely not, maybe): the rows whose key is surely not among wanted's, and the others. Null keys are surely not."""
    (mark,) = fresh(rows, "maybe")
    marked = _marked(rows, key, wanted, mark)
    return marked.where(~F.col(mark)).drop(mark), marked.where(F.col(mark)).drop(mark)
