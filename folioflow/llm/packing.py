"""Packing of token ids into fixed windows: bounded-space, best-fit, online (operator 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stored
from .tokens import Encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Partitions whose last windows meet in one task of the final merge; each brings less than one window.
MERGE = 512


class Packer:
    """At most `keep` open windows. A piece goes to the window it fits tightest; when it fits none and all
    are open, the fullest window is filled up with a cut of it and emitted, and the rest opens a new one."""

    def __init__(self, window: int, keep: int, first: int):
        self.window, self.keep, self.next, self.open = window, keep, first, []

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids) // 4, total, self.next, at, ids
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, start: int, total: int, ids: bytes) -> Iterator[tuple]:
        full = 4 * self.window
        while len(ids) >= full:
            yield from self._emit([(doc, start, total, ids[:full])])
            start, ids = start + self.window, ids[full:]
        if not ids:
            return
        fits = [w for w in self.open if full - w[0] >= len(ids)]
        if fits:
            best = max(fits, key=lambda w: w[0])
            best[0] += len(ids)
            best[1].append((doc, start, total, ids))
            if best[0] == full:
                self.open.remove(best)
                yield from self._emit(best[1])
            return
        if len(self.open) >= self.keep:
            best = max(self.open, key=lambda w: w[0])
            self.open.remove(best)
            cut = full - best[0]
            yield from self._emit([*best[1], (doc, start, total, ids[:cut])])
            start, ids = start + cut // 4, ids[cut:]
        self.open.append([len(ids), [(doc, start, total, ids)]])

    def merge(self) -> Iterator[tuple]:
        """Pour the emptier open windows into the fuller ones until one at most is not full."""
        rest = sorted(self.open, key=lambda w: w[0])
        self.open, self.keep = [], 1
        for w in reversed(rest):
            for piece in w[1]:
                yield from self.add(*piece)

    def last(self) -> Iterator[tuple]:
        for w in self.open:
            yield from self._emit(w[1])
        self.open = []


def _batches(rows: Iterable[tuple], names: str, size: int = 1 << 22):
    """Rows as Arrow batches of about `size` bytes of ids."""
    import pyarrow as pa

    fields = [x.split() for x in names.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in fields])
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[6]) + 64
        if weight >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, keep: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, with their ids, and where each lies in which sequence of at most `window` ids.

    A document's ids are its text's under the tokenizer file and then end_id. Documents are read in the
    order of their partition. Each partition keeps `keep` open windows; at its end they are poured
    together, and the one that is left meets those of up to 511 other partitions in a last merge, so at
    most one window in 512 partitions is not full. Null and empty texts have end_id alone; a null id stays
    null; repeated rows are packed again; no rows give no pieces. Other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def packed(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, end = Encoder.shared(tokenizer), end_id.to_bytes(4, "little")

        def rows():
            packer = Packer(window, keep, part << 34)
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encoder.encode(text.as_py()) + end
                    for piece in packer.add(doc, 0, len(ids) // 4, ids):
                        yield *piece, None
            for piece in packer.merge():
                yield *piece, None
            for piece in packer.last():
                yield *piece, part // MERGE

        yield from _batches(rows(), f"{PIECES}, pool int")

    pool = stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(packed, f"{PIECES}, pool int"), "pack")

    def merged(batches):
        def rows():
            packer, now = None, None
            for batch in batches:
                for *piece, group in zip(*[c.to_pylist() for c in batch.columns]):
                    if group != now:
                        if packer:
                            yield from packer.last()
                        packer, now = Packer(window, 1, 1 << 62 | group << 34), group
                    doc, start, _, total, _, _, ids = piece
                    yield from packer.add(doc, start, total, ids)
            if packer:
                yield from packer.last()

        yield from _batches(rows(), PIECES)

    closed = pool.where("pool IS NULL").drop("pool")
    left = pool.where("pool IS NOT NULL").repartition("pool").sortWithinPartitions("pool", "sequence_id", "offset")
    return closed.unionByName(left.mapInArrow(merged, PIECES))
