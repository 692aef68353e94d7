"""Near-duplicates by MinHash and a multi-index Hamming join (operator 1).

A signature has POSITIONS minima of 32 bits. Texts whose shingle sets agree by 0.75 differ in a quarter of
the positions on average; LIMIT is 4.5 standard deviations above that. LIMIT errors over CHUNKS chunks
leave one chunk with no more than one error, so a key for every chunk and every position left out of it
brings together all pairs within LIMIT: that is guaranteed, and a pair at exactly 0.75 is beyond LIMIT
once in some 60,000 times. What meets, and is within WIDE_LIMIT in a wider signature, is confirmed on the full
shingle sets.

No bucket is ever paired out. Its members are first compared with one of them, twice. Where a bucket still
holds several components, each member that is near another component asks for it, and is compared with that
component's members until one agrees; pairs are never rows. A bucket and a component are cut into blocks: a member
is the target in one block, and asks only in blocks that may hold a near one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import maybe_in, split_maybe
from .common import components, forget, fresh, lookup, release, short_batches, stored

SHINGLE, SIMILARITY = 5, 75
POSITIONS, CHUNKS, LIMIT = 64, 16, 31
#: Texts that meet are told apart by a wider signature of other minima, one byte of each: 4.6 standard deviations.
WIDE, WIDE_LIMIT = 256, 96
CHUNK = POSITIONS // CHUNKS
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 1024
#: Hashes of words that a worker keeps at a time.
CACHED_WORDS = 100_000
#: Times that the members of a bucket are compared with one of them before components ask for each other.
HUBS = 2
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(h):
    """A bijective scramble of unsigned 64-bit numbers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of texts' distinct SHINGLE-word shingles, sorted."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        known = self.words
        try:
            h = np.array([known[w] for w in found], np.uint64)
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in found], np.uint64)
        size = min(SHINGLE, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(_PRIME) + h[k : n + k]
        return np.unique(_mix(out))


def minima(shingles, positions: int = POSITIONS, seed: int = 20240501):
    """The signature of a set that isn't empty."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, positions, dtype=np.uint64)
    best = None
    for at in range(0, len(shingles), 2048):
        low = ((shingles[at : at + 2048, None] * a + b) >> np.uint64(32)).min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best.astype("<u4")


def _text_hashes(text) -> list:
    """128 bits of a text; null has none."""
    return [F.when(text.isNotNull(), h).alias(n) for n, h in (("t1", F.xxhash64(text)), ("t2", F.xxhash64(F.lit("second"), text)))]


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, node, check, signature): node and check are 128 bits of the set."""
    short_batches(docs.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            n, node, check, sig = [], [], [], []
            for t in b.column(3):
                s = shingler(t.as_py())
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                node.append(int.from_bytes(d[:8], "little", signed=True))
                check.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(minima(s).tobytes() if len(s) else None)
            yield pa.record_batch([*b.columns[:3], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "t1", "t2", "n_shingles", "node", "check", "signature"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_text_hashes(text), text.alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, t1 long, t2 long, n_shingles long, node long, check long, signature binary"), "sketch")


def apart(drawn: DataFrame) -> DataFrame:
    """drawn with other nodes where sets that differ in check share one, until none do. Some pairs of sets in 10**10 share
    64 bits."""
    while True:
        shared = drawn.groupBy("node").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").select("node")
        if shared.isEmpty():
            return drawn
        marked = drawn.join(shared.withColumn("clash", F.lit(True)), "node", "left")
        moved = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        drawn = stored(marked.withColumn("node", moved).select(*drawn.columns), "sketch")


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, node): for every chunk of the signature and every position left out of it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            keys = np.empty((len(sig), CHUNKS, CHUNK), np.uint64)
            for j in range(CHUNK):
                h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(j + 1), sig.shape[:2]).copy()
                for k in range(CHUNK):
                    if k != j:
                        h = _mix(h * np.uint64(_PRIME) + sig[:, :, k])
                keys[:, :, j] = h
            node = np.repeat(np.asarray(b.column(0)), CHUNKS * CHUNK)
            yield pa.record_batch([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide signatures differ in WIDE_LIMIT positions or fewer."""
    sig = lambda x: texts.select(F.col("node").alias(x), F.col("wide").alias(f"s{x}"))
    both = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "u1").reshape(-1, WIDE) for i in (2, 3))
            near = pa.array((x != y).sum(axis=1) <= WIDE_LIMIT)
            yield pa.record_batch([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets agree enough."""
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(text("b"), "b").select("a", "b", "tb").join(text("a"), "a").select("a", "b", "ta", "tb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler, held, mine = Shingler(), None, None
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != held:
                    held, mine = a, shingler(ta.as_py())
                other = shingler(tb.as_py())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                good.append(100 * both >= SIMILARITY * (len(mine) + len(other) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _tasks(left: DataFrame) -> int:
    return int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _groups(batches, of: int):
    """Runs of rows that agree in their first `of` columns."""
    rows: list = []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if rows and rows[0][:of] != r[:of]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _reaching(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, to, block): members of a bucket that are within WIDE_LIMIT of a member of another component `to`, which is
    in that block of `to`, asked from the side of the smaller component. left: (key, node, component, size). The members
    of a bucket's largest component ask for nothing; each other one visits the bucket's blocks, and the pairs
    themselves never leave a task."""
    largest = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.max(F.struct("size", (-F.col("component")).alias("component"))).alias("top"))
    cut = left.join(largest, "key").join(texts.select("node", "wide"), "node")
    held = cut.select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"), F.lit(0).alias("asks"), "node", "component", "size", "wide")
    asks = cut.where("component <> -top.component").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own"), F.lit(1).alias("asks"), "node", "component", "size", "wide")
    rows = held.unionByName(asks).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    rows = rows.repartition(_tasks(left), "key", "own").sortWithinPartitions("key", "own", "asks", "node").select("key", "own", "asks", "node", "component", "size", "block", "wide")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found: set = set()
        now, held, there = None, [], None

        def out():
            rows = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "to", "block"])
            found.clear()
            return rows

        for b in batches:
            for key, own, asking, node, comp, size, block, wide in zip(*[c.to_pylist() for c in b.columns]):
                if (key, own) != now:
                    now, held, there = (key, own), [], None
                sig = np.frombuffer(wide, "u1")
                if not asking:
                    held.append((comp, size, block, sig))
                    continue
                if there is None:
                    there = [np.array([r[i] for r in held]) for i in range(4)] if held else []
                if there:
                    comps, sizes, blocks, sigs = there
                    js = np.flatnonzero((comps != comp) & ((sizes > size) | ((sizes == size) & (comps < comp))))
                    if len(js):
                        js = js[(sigs[js] != sig).sum(axis=1) <= WIDE_LIMIT]
                        found.update((node, *p) for p in zip(comps[js].tolist(), blocks[js].tolist()))
                if len(found) > 50_000:
                    yield out()
        if found:
            yield out()

    return rows.mapInArrow(run, "node long, to long, block long").distinct()


def _joined(asked: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes asked (node, to, block) and members (node, component, block) of the components they ask
    for: all members of the block within WIDE_LIMIT are compared in full until one agrees."""
    wanted = asked.select(F.col("to").alias("component"), "block").distinct()
    held = members.join(wanted, ["component", "block"], "left_semi").select("component", "block", F.lit(0).alias("asks"), "node")
    asks = asked.select(F.col("to").alias("component"), "block", F.lit(1).alias("asks"), "node")
    rows = held.unionByName(asks).join(texts, "node").select("component", "block", "asks", "node", "wide", "text")
    rows = rows.repartition(_tasks(asked), "component", "block").sortWithinPartitions("component", "block", "asks", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler, now, out = Shingler(), None, []
        ids, sigs, sets, matrix = [], [], [], None
        for b in batches:
            for comp, block, asking, node, sig, text in zip(*[b.column(i).to_pylist() for i in range(5)], b.column(5)):
                if (comp, block) != now:
                    now, ids, sigs, sets, matrix = (comp, block), [], [], [], None
                sig = np.frombuffer(sig, "u1")
                mine = shingler(text.as_py())
                if not asking:
                    ids.append(node)
                    sigs.append(sig)
                    sets.append(mine)
                    continue
                if matrix is None:
                    matrix = np.array(sigs).reshape(-1, WIDE)
                far = (matrix != sig).sum(axis=1)
                for j in np.argsort(far, kind="stable"):
                    if far[j] > WIDE_LIMIT:
                        break
                    other = sets[j]
                    if min(len(mine), len(other)) * 100 >= SIMILARITY * max(len(mine), len(other)):
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if 100 * both >= SIMILARITY * (len(mine) + len(other) - both):
                            out.append((node, ids[j]))
                            break
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _widened(linked: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components by the links so far, given as (node, component), and more edges (a, b). linked is forgotten."""
    if linked is None:
        return components(edges)
    wider = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))
    forget(linked)
    return wider


def _labels(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, first) for every row: first is the least (doc_id, t1, t2) of its component, null if that
    has no id."""
    spark = docs.sparkSession
    drawn = apart(sketch(docs, id_col, text_col))
    full = drawn.where("n_shingles > 0")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t1", "t2")))
    nodes = stored(full.groupBy("node").agg(F.min_by("signature", F.struct("t1", "t2")).alias("signature"), F.min(F.struct("t1", "t2")).alias("text"), least.alias("first"), F.count("*").alias("copies")), "nodes")
    keys = _keys(nodes)
    groups = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(groups, "key"), "buckets")
    rank = stored(met.groupBy("node").agg(F.sum("n").alias("rank")), "rank")
    texts = stored(_texts(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), rank.select("node").join(nodes.select("node", "text.t1", "text.t2"), "node")), "texts")
    release(spark)

    # A hub is the member that meets most others over all buckets: the likely original of a group of copies.
    open_ = stored(met.join(rank, "node").select("key", "node", "rank", F.col("node").alias("component")), "open")
    forget(met)
    linked, made = None, []
    for turn in range(HUBS):
        hubs = stored(open_.groupBy("key").agg(F.max(F.struct("rank", "node", "component")).alias("hub")), "hubs")
        stars = open_.join(hubs, "key").where("component <> hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        made.append(stored(_confirmed(_near(stars, texts), texts), "edges"))
        release(spark)
        linked = _widened(linked, made[-1])
        # The hub's whole component has had its turn as far as it shares the hub's: the next hub comes from elsewhere.
        labelled = open_.select("key", "node", "rank").join(linked, "node", "left").select("key", "node", "rank", F.coalesce("component", "node").alias("component"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        labelled = labelled.join(mixed, "key", "left_semi")
        seen = hubs.select("key", F.col("hub.node").alias("node"))
        before, open_ = open_, stored(labelled.join(seen, ["key", "node"], "left_anti") if turn + 1 < HUBS else labelled, "open")
        forget(before)
        forget(hubs)
        release(spark)
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    sized = stored(lookup(linked, sizes.withColumn("members", F.col("size")), "component", "members"), "sized")
    left = open_.select("key", "node").join(sized, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    asked = stored(_reaching(left, texts), "asked")
    forget(open_)
    release(spark)
    if not asked.isEmpty():
        alone = rank.select("node").join(linked, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
        members = sized.unionByName(alone).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
        made.append(stored(_joined(asked, members.select("node", "component", "block"), texts), "edges"))
        release(spark)
        if not made[-1].isEmpty():
            linked = _widened(linked, made[-1])
    # From here on rows are nodes, until each row looks its node up.
    nodes_of = nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first", "copies")
    nodes_of = stored(nodes_of, "labelled")
    groups = nodes_of.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    labels = stored(lookup(nodes_of.select("node", "component", "copies"), groups, "component", "n").select("node", "first", "copies"), "labels")
    for frame in (linked, sized, asked, texts, rank, nodes, nodes_of, *made):
        forget(frame)
    rows = drawn.select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    return lookup(rows, labels, "node", "copies").drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Equal sets are one node from the start. Null and empty texts have no shingles and link with nothing;
    rows with a null id take part, are never the smallest and never kept; rows that repeat an id and a text
    share their result; no rows give no rows. Other columns are ignored.
    """
    found = _labels(docs, id_col, text_col)
    out = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text, wide): one text for every wanted node (node, t1, t2), and its wide signature."""
    rows = rows.select("text", *_text_hashes(F.col("text")))
    found = maybe_in(rows, "t1", wanted.select("t1")).dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("node", "text")

    def run(batches):
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            wide = [minima(shingler(t.as_py()), WIDE, 7).astype("u1").tobytes() for t in b.column(1)]
            yield pa.record_batch([*b.columns, pa.array(wide, pa.binary())], names=["node", "text", "wide"])

    return found.mapInArrow(run, "node long, text string, wide binary")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id; all columns stay.

    Rows without an id stay, and so do rows without words. Of rows that repeat an id with different texts each is judged by its own
    text, and the least text hash decides between them; of rows that repeat an id and a text, one stays. Only rows
    that may go are shuffled.
    """
    found = stored(_labels(docs, id_col, text_col).where("doc_id IS NOT NULL").withColumn("own", F.struct("doc_id", "t1", "t2")), "near")
    gone = found.where("n_shingles > 0 AND own <> first").select("own", F.lit(True).alias("gone"))
    again = found.groupBy("own").count().where("count > 1").select("own", F.lit(False).alias("gone"))
    gone = stored(gone.unionByName(again).groupBy("own").agg(F.max("gone").alias("gone")), "gone")
    own, out = fresh(docs, "own", "gone")
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    keyed = docs.withColumn(own, F.when(id_.isNotNull(), F.struct(id_.alias("doc_id"), *_text_hashes(text))))
    sure, maybe = split_maybe(keyed, own, gone.select("own"))
    rest = maybe.join(gone.where("gone").select(F.col("own").alias(out)), F.col(own) == F.col(out), "left_anti").dropDuplicates([own])
    return sure.unionByName(rest).drop(own)
