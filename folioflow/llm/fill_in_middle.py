"""Fill-in-middle transformation by secondary sort (operator 12).

A document becomes pieces of at most CHUNK code points, keyed by its row and by where they stand in the output.
One shuffle by row and a sort by position bring them together; a task then streams them, piece by piece, into a digest
or a text. For restoration the same task reads the output's own markers, gives each piece its place in the text, and
the rows are sorted again where they are. No task holds more than a piece of any document between the two ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Shares in hundredths: documents that are transformed at all, and of them those with the suffix first.
RATE, SPM_RATE = 90, 20
#: Code points of one piece.
CHUNK = 1 << 15
#: Documents and pieces travel under these names: row is the document's own, at the place that pieces are sorted by.
ABOUT = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"{ABOUT}, at long, piece string"
_RESTORED = f"{ABOUT}, output_sha256 string, at long, piece string"


def plan(doc_id: int | None, text: str, seed: int) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text; a null id counts as an empty number."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not text or h3 % 100 >= RATE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, 0, 0
    ends = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return SPM if h4 % 100 < SPM_RATE else PSM, ends[0], ends[1]


def sections(text: str, form: str, first: int, second: int) -> list[str]:
    """The output's sections in their order, each behind its marker."""
    if form == PLAIN:
        return [text]
    prefix, middle, suffix = PREFIX + text[:first], MIDDLE + text[first:second], SUFFIX + text[second:]
    return [suffix, prefix, middle] if form == SPM else [prefix, suffix, middle]


class Restorer:
    """Gives every part of an output, fed in pieces of any length, its place in the text. Markers may lie across pieces."""

    #: Places of the sections in the text; parts of one section count up below.
    PLACES = {PREFIX: 0, MIDDLE: 1 << 40, SUFFIX: 2 << 40}

    def __init__(self, form: str):
        import re

        self.plain, self.place, self.rest = form == PLAIN, 0, ""
        self.marker = re.compile("|".join(map(re.escape, self.PLACES)))

    def _part(self, part: str) -> Iterator[tuple[int, str]]:
        if part:
            yield self.place, part
            self.place += 1

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        if self.plain:
            yield from self._part(piece)
            return
        piece, at = self.rest + piece, 0
        for m in self.marker.finditer(piece):
            yield from self._part(piece[at : m.start()])
            self.place, at = self.PLACES[m[0]], m.end()
        open_at = piece.rfind("<", max(at, len(piece) - len(PREFIX) + 1))
        cut = len(piece) if open_at < 0 else open_at
        yield from self._part(piece[at:cut])
        self.rest = piece[cut:]

    def end(self) -> Iterator[tuple[int, str]]:
        yield from self._part(self.rest)


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows: Iterable[tuple], names: str, size: int = 1 << 20):
    """Rows as Arrow batches of some `size` code points of their last column."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in names.split(", "))])
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1] or "") + 256
        if weight >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pieces(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed documents as PIECES, in no order.

    Null and empty texts are plain and have one empty piece; a null id stays null; every repeated row is a document of
    its own; no rows give no pieces. prefix_chars and middle_chars are null for plain documents. Other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def cut(batches):
        def rows():
            for row, doc, text in _rows(batches):
                text = text or ""
                form, first, second = plan(doc, text, seed)
                about = (row, doc, len(text), form, *((None, None) if form == PLAIN else (first, second - first)))
                at = 0
                for section in sections(text, form, first, second):
                    for k in range(0, max(1, len(section)), CHUNK):
                        yield *about, at + k, section[k : k + CHUNK]
                    at += len(section)

        yield from _batches(rows(), PIECES)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, PIECES)


def assembled(loose: DataFrame) -> DataFrame:
    """PIECES with each document's in one task, one after another, in the order of their places."""
    return loose.repartition("row").sortWithinPartitions("row", "at")


def restored(outputs: DataFrame) -> DataFrame:
    """Pieces of the original texts, in order, made from assembled outputs and their forms alone. One piece of each
    document has the digest of the output that was read."""

    def run(batches):
        import hashlib

        def rows():
            for _, run in groupby(_rows(batches), itemgetter(0)):
                digest, reader = hashlib.sha256(), None
                for *about, _, piece in run:
                    reader = reader or Restorer(about[3])
                    digest.update(piece.encode())
                    for place, part in reader.feed(piece):
                        yield *about, None, place, part
                for place, part in reader.end():
                    yield *about, None, place, part
                yield *about, digest.hexdigest(), Restorer.PLACES[SUFFIX] << 1, ""

        yield from _batches(rows(), _RESTORED)

    return outputs.mapInArrow(run, _RESTORED).sortWithinPartitions("row", "at")


def texts(ordered: DataFrame) -> DataFrame:
    """(row, doc_id, n, form, prefix_chars, middle_chars, text) of ordered pieces, outputs or restored ones."""
    columns = [c.split()[0] for c in ABOUT.split(", ")]

    def run(batches):
        def rows():
            for _, run in groupby(_rows(batches), itemgetter(0)):
                parts = []
                for *about, piece in run:
                    parts.append(piece)
                yield *about[: len(columns)], "".join(parts)

        yield from _batches(rows(), f"{ABOUT}, text string")

    return ordered.select(*columns, "piece").mapInArrow(run, f"{ABOUT}, text string")


def digests(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: its plan, the digest of its output and that of the text rebuilt from it. Nulls, empty
    texts, repeated rows and other columns are as in pieces()."""
    names = f"{ABOUT}, output_sha256 string, restored_sha256 string"

    def run(batches):
        import hashlib

        def rows():
            for _, run in groupby(_rows(batches), itemgetter(0)):
                digest = hashlib.sha256()
                for *about, output, _, piece in run:
                    digest.update(piece.encode())
                yield *about, output, digest.hexdigest()

        yield from _batches(rows(), names)

    return restored(assembled(pieces(docs, seed, id_col, text_col))).mapInArrow(run, names).drop("row")
