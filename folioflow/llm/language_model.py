"""Interpolated modified Kneser-Ney model over characters, for the quality of documents (operator 7).

The model counts GRAM-grams of characters as they are, in tables that grow with the trusted texts and stay
sharded by gram. Documents are dealt into groups; the distinct grams of a group are joined with the tables, order
by order, and the answers meet the group's texts again. Every text, trusted or not, is scored by a model that
leaves out its own fold of the trusted ones, so that thresholds and decisions rest on scores of one kind.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import members
from .common import forget, packed, release, short_batches, stored, unpacked

#: Share of trusted documents of a language that its threshold leaves below.
QUANTILE = 0.995
#: A text of n characters is judged by the lower end of what its mean may be: SLACK / sqrt(n) below it.
SLACK = 2.0
#: Characters in a gram; before a text stands PAD, a code point that no text may hold.
GRAM, PAD = 5, "\uffff"
#: Characters of text in a group of documents, characters whose grams are worked out at a time, and grams that a
#: task holds before it passes them on.
GROUP_CHARS, BLOCK_CHARS, HELD_GRAMS = 32_000_000, 1 << 20, 1_000_000
#: A trusted text is in one of so many folds, by its id.
FOLDS = 5
#: Logarithms of probabilities travel as 16-bit numbers in steps of 1 / STEP.
STEP = 1024


def fold(id_):
    """The fold of an id; null ids are in fold 0."""
    return F.when(id_.isNull(), 0).otherwise(F.pmod(F.xxhash64(id_), F.lit(FOLDS))).cast("int")


#: Code points that a 12-bit number stands for, so that five of them fit a 64-bit key: all below the first bound, and
#: from the second to the third, which holds dashes, quotation marks and currencies. PAD has a number too; texts with
#: other characters are wide.
_LOW, _HIGH, _END = 0x0F00, 0x2000, 0x20D0
_BITS = 12


def _numbers():
    """The number of every 16-bit code point, 2**_BITS - 1 for those without one."""
    import numpy as np

    out = np.full(1 << 16, (1 << _BITS) - 1, np.uint16)
    out[:_LOW] = np.arange(_LOW)
    out[_HIGH:_END] = np.arange(_LOW, _LOW + _END - _HIGH)
    out[ord(PAD)] = _LOW + _END - _HIGH
    return out


def _points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def narrow(text: str) -> bool:
    """Whether all characters of a text have a number."""
    if text.isascii():
        return True
    return not _WIDE.search(text)


_WIDE = re.compile(f"[{chr(_LOW)}-{chr(_HIGH - 1)}{chr(_END)}-{chr(0x10FFFF)}]")


def gram_keys(texts: list[str]):
    """(key of every gram of narrow texts, place of each text's first key). Between two texts lie GRAM - 1 keys of no text."""
    import numpy as np

    places = _numbers()[_points("".join([PAD * (GRAM - 1) + t for t in texts]))].astype(np.uint64)
    keys = places[: len(places) - GRAM + 1].copy()
    for k in range(1, GRAM):
        keys <<= np.uint64(_BITS)
        keys |= places[k : len(places) - GRAM + 1 + k]
    return keys, np.cumsum([0] + [len(t) + GRAM - 1 for t in texts])[:-1]


def distinct(keys, weights=None):
    """The distinct keys in order, and the sum of weights (or the number) of each."""
    import numpy as np

    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sums = np.diff(np.append(starts, len(keys))) if weights is None else np.add.reduceat(weights, starts) if len(starts) else weights
    return keys[starts], sums


def own_keys(texts: list[str]):
    """The keys of all grams of narrow texts."""
    import numpy as np

    keys, starts = gram_keys(texts)
    own = np.ones(len(keys), bool)
    for k in range(1, GRAM):
        own[(starts - k)[starts >= k]] = False
    return keys[own]


def grams_of(keys) -> list[str]:
    """The grams that keys stand for."""
    import numpy as np

    back = np.concatenate([np.arange(_LOW), np.arange(_HIGH, _END), [ord(PAD)]]).astype(np.uint32)
    signs = np.empty((len(keys), GRAM), np.uint32)
    for k in range(GRAM):
        signs[:, GRAM - 1 - k] = back[((keys >> np.uint64(_BITS * k)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
    joined = signs.tobytes().decode("utf-32-le")
    return [joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]


def keys_of(grams: list[str]):
    """(keys, which grams have one)."""
    import numpy as np

    points = _points("".join(grams)).reshape(-1, GRAM)
    none = (1 << _BITS) - 1
    places = np.where(points < 1 << 16, _numbers()[points & 0xFFFF], none).astype(np.uint64)
    keys = np.zeros(len(points), np.uint64)
    for k in range(GRAM):
        keys = (keys << np.uint64(_BITS)) | places[:, k]
    return keys, (places < none).all(axis=1)


def wide_grams(text: str) -> list[str]:
    text = PAD * (GRAM - 1) + text
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


class Table:
    """Values by key, looked up for a million keys at once: each key has one slot of a large table, and those that would
    share a slot are searched for."""

    def __init__(self, keys, values):
        import numpy as np

        self.bits = max(12, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        slots = self._slots(keys)
        self.keys[slots], self.values[slots] = keys, values
        if len(keys):
            # Key 0 is a gram of NULs: an empty slot must not look like it.
            self.keys[np.setdiff1d([0], slots)] = np.uint64(1 << 63)
        late = self.keys[slots] != keys
        order = np.argsort(keys[late])
        self.late, self.late_values = keys[late][order], np.asarray(values, np.float32)[late][order]

    def _slots(self, keys):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys):
        """The values of keys, 0 for those that aren't there."""
        import numpy as np

        slots = self._slots(keys)
        out = self.values[slots]
        other = np.flatnonzero(self.keys[slots] != keys)
        out[other] = 0
        if len(other) and len(self.late):
            at = np.minimum(np.searchsorted(self.late, keys[other]), len(self.late) - 1)
            hit = self.late[at] == keys[other]
            out[other[hit]] = self.late_values[at[hit]]
        return out


def _blocks(rows):
    """Rows (size, row) in lists of about BLOCK_CHARS characters."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(rows: DataFrame) -> DataFrame:
    """(gram, m0, m1, ...) of rows (text, part): how often the texts of each part hold it, added up in each task as far as it
    can hold them."""
    short_batches(rows.sparkSession)
    columns = [f"m{f}" for f in range(FOLDS)]

    def run(batches):
        from collections import Counter, defaultdict

        import numpy as np
        import pyarrow as pa

        held, rare = defaultdict(list), defaultdict(Counter)
        waiting, sizes = defaultdict(list), defaultdict(int)

        def batch(grams, table):
            return pa.record_batch([pa.array(grams, pa.string()), *[pa.array(np.ascontiguousarray(t), pa.int64()) for t in table]], names=["gram", *columns])

        def out():
            parts = {p: distinct(*map(np.concatenate, zip(*held.pop(p)))) for p in [*held]}
            keys = distinct(np.concatenate([k for k, _ in parts.values()]))[0] if parts else np.zeros(0, np.uint64)
            table = np.zeros((FOLDS, len(keys)), np.int64)
            for p, (k, n) in parts.items():
                table[p, np.searchsorted(keys, k)] = n
            for at in range(0, len(keys), 1 << 16):
                yield batch(grams_of(keys[at : at + (1 << 16)]), table[:, at : at + (1 << 16)])
            grams = sorted({g for found in rare.values() for g in found})
            for at in range(0, len(grams), 1 << 16):
                own = grams[at : at + (1 << 16)]
                yield batch(own, np.array([[rare[p][g] for g in own] for p in range(FOLDS)], np.int64))
            rare.clear()

        def add(part):
            held[part].append(distinct(own_keys(waiting.pop(part))))
            del sizes[part]
            if sum(len(k) for k, _ in held[part]) > HELD_GRAMS // FOLDS:
                held[part] = [distinct(*map(np.concatenate, zip(*held[part])))]

        for b in batches:
            for t, part in zip(b.column(0), b.column(1).to_pylist()):
                if not (text := t.as_py()):
                    continue
                if not narrow(text):
                    rare[part].update(wide_grams(text))
                    continue
                waiting[part].append(text)
                sizes[part] += len(text)
                if sizes[part] >= BLOCK_CHARS:
                    add(part)
            if sum(len(k) for of in held.values() for k, _ in of) + sum(map(len, rare.values())) > 2 * HELD_GRAMS:
                yield from out()
        for part in [*waiting]:
            add(part)
        yield from out()

    return rows.select("text", "part").mapInArrow(run, "gram string, " + ", ".join(f"{c} long" for c in columns))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams seen once to four times."""
    n = [0, *n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(min(k, max(0.05 * k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3))


def sharded(texts: DataFrame) -> tuple[list, float]:
    """For orders 1 to GRAM the tables (gram, p0, ...) and (context, b0, ...) of seen grams' probabilities and of contexts'
    backing off, and the probability of a character at order 0. Model f is of the texts (text, part) outside part f."""
    models = range(FOLDS)
    sums = counted(texts).groupBy("gram").agg(*[F.sum(f"m{f}").alias(f"m{f}") for f in models])
    whole = sum((F.col(f"m{f}") for f in models[1:]), F.col("m0"))
    counts = {GRAM: stored(sums.select("gram", *[(whole - F.col(f"m{f}")).alias(f"n{f}") for f in models]), "grams")}
    for k in range(GRAM - 1, 0, -1):
        counts[k] = stored(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in models]), "grams")
    base = 1 / (counts[1].count() + 1)
    orders = None
    for k, rows in counts.items():
        rows = rows.select(F.lit(k).alias("k"), *[f"n{f}" for f in models])
        orders = rows if orders is None else orders.unionByName(rows)
    seen = {r["k"]: r for r in orders.groupBy("k").agg(*[F.count_if(F.col(f"n{f}") == i).alias(f"{f}_{i}") for f in models for i in range(1, 5)]).collect()}
    tables, lower = [], None
    for k in range(1, GRAM + 1):
        cuts = [discounts([seen[k][f"{f}_{i}"] if k in seen else 0 for i in range(1, 5)]) for f in models]
        cut = lambda f: F.when(F.col(f"n{f}") <= 0, 0.0).when(F.col(f"n{f}") == 1, cuts[f][0]).when(F.col(f"n{f}") == 2, cuts[f][1]).otherwise(cuts[f][2])  # noqa: B023, E731
        rows = counts[k].select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"), *[f"n{f}" for f in models], *[cut(f).alias(f"d{f}") for f in models])
        contexts = rows.groupBy("context").agg(*[F.sum(f"n{f}").alias(f"t{f}") for f in models], *[F.coalesce(F.try_divide(F.sum(f"d{f}"), F.sum(f"n{f}")), F.lit(1.0)).alias(f"b{f}") for f in models])
        full = rows.join(contexts, "context")
        if lower is None:
            full = full.select("*", *[F.lit(base).alias(f"r{f}") for f in models])
        else:
            full = full.join(lower.select(F.col("gram").alias("suffix"), *[F.col(f"p{f}").alias(f"r{f}") for f in models]), "suffix")
        own = [(F.coalesce(F.try_divide(F.col(f"n{f}") - F.col(f"d{f}"), F.col(f"t{f}")), F.lit(0.0)) + F.col(f"b{f}") * F.col(f"r{f}")).alias(f"p{f}") for f in models]
        lower = stored(full.select("gram", *own), "order")
        tables.append((lower, contexts.select("context", *[f"b{f}" for f in models]), counts[k]))
    return tables, base


def answers(grams: DataFrame, tables: list, base: float) -> DataFrame:
    """(gram, p0, ...) for distinct grams of as many characters as tables has orders: the seen ones' own probabilities, the
    others' from backing off to their last characters."""
    k, ps = len(tables), [f"p{f}" for f in range(FOLDS)]
    found = stored(grams.join(tables[-1][0], "gram", "left"), "found")
    missing = found.where("p0 IS NULL").select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
    backed = missing.join(tables[-1][1], "context", "left")
    if k == 1:
        rest = backed.select("*", *[F.lit(base).alias(f"r{p}") for p in ps])
    else:
        less = answers(missing.select(F.col("suffix").alias("gram")).distinct(), tables[:-1], base)
        rest = backed.join(less.select(F.col("gram").alias("suffix"), *[F.col(p).alias(f"r{p}") for p in ps]), "suffix")
    return found.where("p0 IS NOT NULL").unionByName(rest.select("gram", *[(F.coalesce(F.col(f"b{p[1:]}"), F.lit(1.0)) * F.col(f"r{p}")).alias(p) for p in ps]))


def _asked(groups: DataFrame) -> DataFrame:
    """(part, gram): the distinct grams of the texts in rows (part, blob), which come sorted by part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, held, rare, waiting, size = None, [], set(), [], 0

        def settle():
            if waiting:
                held.append(distinct(own_keys(waiting))[0])
                waiting.clear()
            if sum(map(len, held)) > HELD_GRAMS:
                held[:] = [distinct(np.concatenate(held))[0]]

        def out():
            settle()
            keys = distinct(np.concatenate(held))[0] if held else np.zeros(0, np.uint64)
            for at in range(0, len(keys), 1 << 16):
                own = grams_of(keys[at : at + (1 << 16)])
                yield pa.record_batch([pa.array([now] * len(own), pa.int32()), pa.array(own, pa.string())], names=["part", "gram"])
            grams = sorted(rare - set(grams_of(keys))) if rare else []
            for at in range(0, len(grams), 1 << 16):
                own = grams[at : at + (1 << 16)]
                yield pa.record_batch([pa.array([now] * len(own), pa.int32()), pa.array(own, pa.string())], names=["part", "gram"])
            held.clear()
            rare.clear()

        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if part != now:
                    yield from out()
                    now, size = part, 0
                for text in unpacked(blob).column("text").to_pylist():
                    if text and narrow(text):
                        waiting.append(text)
                        size += len(text)
                        if size >= BLOCK_CHARS:
                            settle()
                            size = 0
                    elif text:
                        rare.update(wide_grams(text))
        yield from out()

    return groups.select("part", "blob").mapInArrow(run, "part int, gram string")


def _scored(groups: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, n) of rows (part, kind, blob) sorted by part and kind: answers first, then texts."""

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        now, told, table, logs = None, [], None, None
        for b in batches:
            for part, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now:
                    now, told, table, logs = part, [], None, None
                rows = unpacked(blob)
                if kind == 0:
                    told.append(rows)
                    continue
                if table is None:
                    answers = pa.concat_tables(told) if told else pa.table({"gram": pa.array([], pa.string()), "log": pa.array([], pa.int16())})
                    value = answers.column("log").to_numpy().astype(np.float32) / STEP
                    keys, short = keys_of(answers.column("gram").to_pylist())
                    table = Table(keys[short], value[short])
                texts = [t or "" for t in rows.column("text").to_pylist()]
                total, n = np.zeros(len(texts)), np.array([len(t) for t in texts])
                wide = [i for i, t in enumerate(texts) if t and not narrow(t)]
                skip = set(wide)
                for block in _blocks((len(t), i) for i, t in enumerate(texts) if t and i not in skip):
                    keys, starts = gram_keys([texts[i] for i in block])
                    spans = np.stack([starts, np.minimum(starts + n[block], len(keys) - 1)], axis=1).reshape(-1)
                    found = table[keys].astype(float)
                    # A span's end is the first of the keys that belong to no text, or the last key there is.
                    sums = np.add.reduceat(found, spans)[::2]
                    if starts[-1] + n[block[-1]] > len(keys) - 1:
                        sums[-1] = found[starts[-1] :].sum()
                    total[block] = sums
                if wide and logs is None:
                    logs = dict(zip(answers.column("gram").to_pylist(), value.tolist()))
                for i in wide:
                    total[i] = math.fsum(map(logs.__getitem__, wide_grams(texts[i])))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.exp(-total / n)
                yield pa.record_batch([rows.column("doc_id").combine_chunks(), rows.column("lang").combine_chunks(), pa.array(score, pa.float64(), mask=n == 0), pa.array(n, pa.int64())], names=["doc_id", "lang", "perplexity", "n"])

    return groups.mapInArrow(run, "doc_id long, lang string, perplexity double, n long")


def perplexities(docs: DataFrame, tables: list, base: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity, n) of whole texts and their lengths; without a character it is null. The model is
    that which leaves out the id's fold.

    A group is a hash of language, text and id within a fold, so it has the same rows however docs are laid out,
    and is read as a stream: what a task holds is the distinct grams of one group. Texts are shuffled twice,
    packed and compressed. The tables are forgotten once they have answered.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    groups = int((rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // (FOLDS * GROUP_CHARS)) + 1
    part = (F.pmod(F.xxhash64("lang", "text", "doc_id"), F.lit(groups)) * FOLDS + fold(F.col("doc_id"))).cast("int")
    texts = packed(rows.select(part.alias("part"), "doc_id", "lang", "text"))
    asked = stored(_asked(texts.repartition("part").sortWithinPartitions("part")), "asked")
    release(docs.sparkSession)
    got = answers(asked.select("gram").distinct(), tables, base)
    p = F.array(*[F.col(f"p{f}") for f in range(FOLDS)])[F.col("part") % FOLDS]
    log = F.greatest(F.round(F.log(p) * STEP), F.lit(-32768)).cast("short")
    logs = stored(packed(asked.join(got, "gram").select("part", "gram", log.alias("log"))), "logs")
    for frame in (asked, *[frame for table in tables for frame in (table[0], table[2])]):
        forget(frame)
    release(docs.sparkSession)
    both = logs.select("part", F.lit(0).alias("kind"), "blob").unionByName(texts.select("part", F.lit(1).alias("kind"), "blob"))
    return _scored(both.repartition("part").sortWithinPartitions("part", "kind"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, bound, threshold, kept) for every row of docs.

    The models are trained on all texts whose label says quality 1; a text's perplexity is by the model of those
    outside its fold, so no trusted text has been seen by the model that scores it. `bound` is the lower end of the
    perplexity, so that a few words in a row don't condemn a short text. A language's threshold is that quantile of
    its trusted texts' bounds, or of all trusted ones' where it has none; kept means at or below it.
    Null and empty texts have no perplexity and aren't kept. Null ids are scored, never trusted; repeated
    rows are scored again; without trusted rows there is no threshold and every text is kept. Other columns are
    ignored.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("k")).where("k IS NOT NULL").distinct()
    own = members(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", trusted)
    tables, base = sharded(own.select("text", fold(F.col("doc_id")).alias("part")))
    release(docs.sparkSession)
    lower = F.exp(-SLACK / F.sqrt(F.greatest("n", F.lit(1))))
    scored = stored(perplexities(docs, tables, base).withColumn("bound", F.col("perplexity") * lower).drop("n"), "perplexity")
    known = scored.where("perplexity IS NOT NULL").join(trusted, F.col("doc_id") == F.col("k"), "left_semi")
    cut = F.percentile_approx("bound", quantile, 10000)
    by_lang = known.groupBy(F.col("lang").alias("of")).agg(cut.alias("own"))
    overall = known.agg(cut).first()[0]
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").select("doc_id", "lang", "perplexity", "bound", F.coalesce(F.col("own"), F.lit(overall).cast("double")).alias("threshold"))
    return joined.withColumn("kept", F.coalesce(F.col("bound") <= F.col("threshold"), F.col("perplexity").isNotNull() & F.col("threshold").isNull()))
