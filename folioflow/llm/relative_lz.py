"""Substring dedup by relative Lempel-Ziv parsing (operator 13).

Every text is its own reference and a part of everyone else's. Its windows of SPAN words are cut into blocks where the
text says so: a window belongs to the least hash of the grams of ANCHOR words in it, and windows in a row that have the
same least gram are one block, wherever they stand. Blocks are indexed by that gram. A text is parsed against all blocks
of its grams: a block that equals an earlier one is a factor from there, and factors that go on in the same source are one.
Where a gram leads to several different blocks, a factor of some text ends inside them; the windows of these blocks, and of
no others, are looked up one by one. So every window is judged, and most by a look at its block.

A window's identity is 128 bits, its gram's 64 and its block's or its own 64. Nothing holds a group of equal blocks: a task
sends what it has seen before only once, and the index is read as a sorted stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, short_batches, stored

SPAN, ANCHOR = 20, 6
#: Blocks that a task remembers at a time, to send those that come again only once.
REMEMBERED = 200_000
#: Hashes of words that a worker keeps at a time.
CACHED_WORDS = 200_000
#: A span has the first word of its first window in the upper half and that of its last one in the lower. A row without
#: source_lo is a block that is sought in the index; one with it has been found, and shard only deals it out.
BLOCKS = "shard long, identity long, doc_id long, row long, span long, source long, source_lo long"
#: Found windows, and blocks whose windows are to be looked up (gram is not null).
FOUND = "gram long, row long, span long, source long, source_lo long"
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BITS = (1 << 64) - 1


def _mix(h):
    """A bijective scramble of unsigned 64-bit numbers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of a text's words, which are what lies between ASCII white space."""

    class _Known(dict):
        def __missing__(self, word: bytes) -> int:
            import xxhash

            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    def __init__(self):
        self.known = self._Known()

    def __call__(self, text: str | None):
        import numpy as np

        found = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))


class Runs:
    """Hashes of any runs of words of one text, by sums over its start: a run's is the same wherever it stands."""

    def __init__(self, words, base: int):
        import numpy as np

        n = len(words)
        power = np.full(n + 1, base, np.uint64)
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back, self.sums = np.cumprod(back), np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(power)[:n], out=self.sums[1:])

    def __call__(self, start, end):
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def blocks(words):
    """(gram, identity, lo, hi) of a text's blocks as arrays; there are none below SPAN words."""
    import numpy as np

    n = len(words) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    first, second = Runs(words, _FIRST), Runs(words, _SECOND)
    at = np.arange(len(words) - ANCHOR + 1)
    grams = first(at, at + ANCHOR)
    reach = SPAN - ANCHOR + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(n)
    lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    hi = np.append(lo[1:], n) - 1
    anchor = least[lo]
    shape = ((anchor - lo) * 64 + (hi - lo)).astype(np.uint64)
    identity = _mix(second(lo, hi + SPAN) + shape * np.uint64(_FIRST))
    return grams[anchor].view(np.int64), identity.view(np.int64), lo, hi


class Places:
    """Where blocks or windows start, as arrays: whether the document has an id, its id, its row, the first word."""

    def __init__(self, known, ids, rows, lo):
        self.parts = (known, ids, rows, lo)

    def __getitem__(self, at):
        return Places(*[p[at] for p in self.parts])

    def before(self, other: Places):
        """Whether each place comes before the other's, nulls first."""
        import numpy as np

        less, same = np.zeros(len(self.parts[0]), bool), np.ones(len(self.parts[0]), bool)
        for a, b in zip(self.parts, other.parts):
            less |= same & (a < b)
            same &= a == b
        return less

    def joined(self, other: Places) -> Places:
        import numpy as np

        return Places(*[np.concatenate(x) for x in zip(self.parts, other.parts)])


class Seen:
    """Remembers where keys were seen first, up to REMEMBERED of them; of more, those that came again stay."""

    def __init__(self):
        import numpy as np

        none = np.zeros(0, np.int64)
        self.key, self.shard, self.identity, self.again = none.view(np.uint64), none, none, none.astype(bool)
        self.places = Places(none.astype(bool), none, none, none)

    def __call__(self, shard, identity, places: Places):
        """Whether each of some distinct keys was seen at an earlier place, and the places of those that were. The others
        are remembered."""
        import numpy as np

        key = shard.view(np.uint64) ^ _mix(identity.view(np.uint64))
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        met = (self.key[at] == key) & (self.shard[at] == shard) & (self.identity[at] == identity) if len(self.key) else np.zeros(len(key), bool)
        earlier = met.copy()
        earlier[met] = self.places[at[met]].before(places[met])
        self.again[at[met]] = True
        sources, new = self.places[at[earlier]], ~earlier
        kept = np.ones(len(self.key), bool)
        kept[at[met & new]] = False
        if int(kept.sum()) + int(new.sum()) > REMEMBERED:
            kept &= self.again if int(self.again.sum()) <= REMEMBERED // 2 else False
        merged = np.concatenate([self.key[kept], key[new]])
        order = np.argsort(merged, kind="stable")
        self.key = merged[order]
        self.shard, self.identity = np.concatenate([self.shard[kept], shard[new]])[order], np.concatenate([self.identity[kept], identity[new]])[order]
        self.again = np.concatenate([self.again[kept], np.zeros(int(new.sum()), bool)])[order]
        self.places = self.places[kept].joined(places[new])[order]
        return earlier, sources


def _factors(row, lo, hi, known, source, source_lo):
    """Where, in arrays sorted by row and lo, a new factor begins: those that go on in the same source are one, greedily."""
    import numpy as np

    on = (row[1:] == row[:-1]) & (known[1:] == known[:-1]) & (source[1:] == source[:-1]) & (source_lo[1:] - lo[1:] == source_lo[:-1] - lo[:-1]) & (lo[1:] <= hi[:-1] + 1)
    return np.flatnonzero(np.append(True, ~on)) if len(row) else np.zeros(0, np.int64)


def _longs(values, known=None):
    import pyarrow as pa

    return pa.array(values, pa.int64(), mask=None if known is None else ~known)


def _dealt(seen: Seen, shard, identity, hi, places: Places):
    """A batch of BLOCKS: what this task sees first, and what it has seen earlier as found, in factors."""
    import numpy as np
    import pyarrow as pa

    known, ids, rows, lo = places.parts
    order = np.lexsort((lo, rows, ids, known, identity, shard))
    s, i = shard[order], identity[order]
    first = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))[: len(order)]
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    lead = order[first]
    earlier, sources = seen(shard[lead], identity[lead], places[lead])
    # What the batch repeats comes from its first, what earlier batches had from there.
    found, of = np.concatenate([order[~first], lead[earlier]]), places[leader[~first]].joined(sources)
    sort = np.lexsort((lo[found], rows[found]))
    found, of = found[sort], of[sort]
    starts = _factors(rows[found], lo[found], hi[found], of.parts[0], of.parts[1], of.parts[3])
    ends = np.append(starts[1:], len(found))[: len(starts)] - 1
    head, sent = found[starts], lead[~earlier]
    none, every = np.zeros(len(sent), np.int64), np.concatenate([sent, head])
    columns = [
        _longs(np.concatenate([shard[sent], rows[head] ^ lo[head] << 40])), _longs(np.concatenate([identity[sent], 0 * head])), _longs(ids[every], known[every]), _longs(rows[every]),
        _longs(np.concatenate([lo[sent] << 32 | hi[sent], lo[head] << 32 | hi[found[ends]]])),
        _longs(np.concatenate([none, of.parts[1][starts]]), np.concatenate([none.astype(bool), of.parts[0][starts]])), _longs(np.concatenate([none, of.parts[3][starts]]), np.arange(len(every)) >= len(sent)),
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


def _documents(batch, id_column: int = 1, row_column: int = 0):
    """Whether the documents of a batch have ids, their ids, and their rows."""
    import pyarrow.compute as pc

    ids = batch.column(id_column)
    return pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(), batch.column(row_column).to_numpy()


def _cut(batches):
    """Blocks of (row, doc_id, text); those that this task has seen before are found already."""
    import numpy as np

    words, seen = Words(), Seen()
    for b in batches:
        cut = [blocks(words(t.as_py())) for t in b.column(2)]
        if not any(len(c[0]) for c in cut):
            continue
        shard, identity, lo, hi = (np.concatenate(x) for x in zip(*cut))
        of = np.repeat(np.arange(len(cut)), [len(c[0]) for c in cut])
        known, ids, rows = (x[of] for x in _documents(b))
        yield _dealt(seen, shard, identity, hi, Places(known, ids, rows, lo))


def _parsed(batches):
    """Sorted blocks against the index: a block that isn't the first of its identity is found in that; the first ones of
    a gram that leads to several are handed on with the gram. What a gram holds back is its first block, as long as no
    other identity has come."""
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in FOUND.split(", ")]
    gram = identity = first = alone = None
    for b in batches:
        done = np.asarray(b.column(6).is_valid())
        yield pa.record_batch([pa.nulls(int(done.sum()), pa.int64()), *[b.column(k).filter(pa.array(done)) for k in (3, 4, 5, 6)]], names=names)
        if done.all():
            continue
        shard, ident, span = (b.column(k).to_numpy()[~done] for k in (0, 1, 4))
        known, ids, row = (x[~done] for x in _documents(b, 2, 3))
        n = len(shard)
        new_gram = np.append(gram is None or shard[0] != gram, shard[1:] != shard[:-1])
        new = new_gram | np.append(identity is None or ident[0] != identity, ident[1:] != ident[:-1])
        run = np.cumsum(new_gram)
        several = np.bincount(run, weights=new).astype(int)
        opened = new & np.where(new_gram, several[run] > 1, True)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        source_known, source, source_lo = known[at], ids[at], span[at] >> 32
        if at[0] < 0:
            source_known[at < 0], source[at < 0], source_lo[at < 0] = first
        again = ~new
        held = [alone] if alone and several[0] else []
        grams = np.concatenate([np.array([gram for _ in held], np.int64), shard[opened]])
        out = [np.concatenate([np.array([h[k] for h in held], np.int64), x[opened]]) for k, x in enumerate((row, span))]
        yield pa.record_batch([_longs(grams), *map(_longs, out), pa.nulls(len(grams), pa.int64()), pa.nulls(len(grams), pa.int64())], names=names)
        yield pa.record_batch([pa.nulls(int(again.sum()), pa.int64()), _longs(row[again]), _longs(span[again]), _longs(source[again], source_known[again]), _longs(source_lo[again])], names=names)
        if new_gram.any():
            k = int(np.flatnonzero(new_gram)[-1])
            alone = (int(row[k]), int(span[k])) if several[run[-1]] == 1 else None
        elif held:
            alone = None
        if new.any():
            k = int(np.flatnonzero(new)[-1])
            first = bool(known[k]), int(ids[k]), int(span[k]) >> 32
        gram, identity = int(shard[-1]), int(ident[-1])


def _windows(batches):
    """Single windows of (row, doc_id, text, undecided blocks) as BLOCKS: shard is the window, identity its gram."""
    import numpy as np

    words, seen = Words(), Seen()
    for b in batches:
        lists = b.column(3)
        bounds, inner = lists.offsets.to_numpy(), lists.values
        gram, span = (inner.field(k).to_numpy() for k in (0, 1))
        made = []
        for k, text in enumerate(b.column(2)):
            own = slice(int(bounds[k]), int(bounds[k + 1]))
            lo, hi = span[own] >> 32, span[own] & 0xFFFFFFFF
            sizes = hi - lo + 1
            at = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            made.append((Runs(words(text.as_py()), _SECOND)(at, at + SPAN).view(np.int64), np.repeat(gram[own], sizes), at))
        if made:
            window, grams, at = (np.concatenate(x) for x in zip(*made))
            known, ids, rows = (x[np.repeat(np.arange(len(made)), [len(m[0]) for m in made])] for x in _documents(b))
            yield _dealt(seen, window, grams, at, Places(known, ids, rows, at))


def _looked_up(sought: DataFrame) -> DataFrame:
    """BLOCKS, those of one shard together and in order."""
    return sought.repartition("shard").sortWithinPartitions("shard", "identity", F.col("doc_id").asc_nulls_first(), "row", "span")


def _found(held: DataFrame) -> DataFrame:
    """(row, span, source, source_lo) of the windows of held (row, doc_id, text) that also start earlier."""
    parsed = stored(_looked_up(held.mapInArrow(_cut, BLOCKS)).mapInArrow(_parsed, FOUND), "blocks")
    release(held.sparkSession)
    undecided = parsed.where("gram IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("gram", "span")).alias("undecided"))
    windows = held.join(undecided, "row").select("row", "doc_id", "text", "undecided").mapInArrow(_windows, BLOCKS)
    singles = stored(_looked_up(windows).mapInArrow(_parsed, FOUND), "windows")
    release(held.sparkSession)
    return parsed.unionByName(singles).where("gram IS NULL").select("row", "span", "source", "source_lo")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors): kept has the words, joined by one space, that no window of SPAN words
    covers which also starts earlier, in a smaller id or before in the same document. factors are the stretches that were
    removed, as parsed: start and length in words, and the id and word where the same words start earlier.

    Windows are judged on the whole input. Null and empty texts have no words and keep the empty text. Null ids come first;
    rows of one id are documents one after another, so the windows of a repeated row are found in the first of them. No
    rows give no rows. Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    spans = _found(held).groupBy("row").agg(F.collect_list(F.struct("span", "source", "source_lo")).alias("spans"))

    def kept(batches):
        from itertools import compress

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(2)
            of = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            inner = lists.flatten()
            span, source, start = (pc.fill_null(inner.field(k), 0).to_numpy() for k in range(3))
            lo, hi, known = span >> 32, span & 0xFFFFFFFF, pc.is_valid(inner.field(1)).to_numpy(zero_copy_only=False)
            order = np.lexsort((hi, lo, of))
            of, lo, hi, source, start, known = (x[order] for x in (of, lo, hi, source, start, known))
            begin = _factors(of, lo, hi, known, source, start)
            end = np.append(begin[1:], len(of))[: len(begin)] - 1
            bounds = np.searchsorted(of[begin], np.arange(len(b) + 1))
            n_words, n_removed, left = [], [], []
            for k, text in enumerate(b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = slice(bounds[k], bounds[k + 1])
                n_words.append(len(words))
                if bounds[k] < bounds[k + 1]:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, lo[begin[own]], 1)
                    np.add.at(edges, hi[end[own]] + SPAN, -1)
                    stays = (np.cumsum(edges)[:-1] == 0).tolist()
                    words = list(compress(words, stays))
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words))
            told = pa.StructArray.from_arrays([_longs(lo[begin]), _longs(hi[end] - lo[begin] + SPAN), _longs(source[begin], known[begin]), _longs(start[begin])], ["start", "length", "source", "source_start"])
            columns = [b.column(0), _longs(n_words), _longs(n_removed), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), told), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "factors", "kept"])

    out = "doc_id long, n_words long, n_removed long, factors array<struct<start:long,length:long,source:long,source_start:long>>, kept string"
    return held.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(kept, out)
