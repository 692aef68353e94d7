"""Token ids in Simple-8b words (operator 3).

An image holds the ids of some documents: a header, the documents' ids and lengths, the word offset of every
block of BLOCK ids, and 64-bit words. A word's top four bits select how many ids of how many bits lie in the
other sixty; the last selector is the escape for an id that fits none of the narrower widths. A block starts
a word of its own, so blocks are decoded side by side, or alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, stored
from .tokens import Encoder

#: Ids in a word and bits of each, by selector: the fixed values of the code.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 256
MAGIC = 0x38425331
#: Ids after which an image is closed; a longer document makes a longer image.
IMAGE_IDS = 1 << 20


def encode_ids(ids):
    """(words, word offset of each block) of an unsigned array; ids of up to 60 bits."""
    import numpy as np

    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    padded = np.zeros((blocks, BLOCK + max(COUNTS)), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # A 32-bit float holds ids of up to 24 bits exactly, and that is most vocabularies.
    most = int(ids.max())
    if most < 1 << 24:
        bits = np.frexp(padded.astype(np.float32))[1].astype(np.uint8).reshape(-1)
    else:
        high = padded >> np.uint64(30)
        bits = np.where(high > 0, np.frexp(high.astype(float))[1] + 30, np.frexp(padded.astype(float))[1]).astype(np.uint8).reshape(-1)
    # The widest of the next c numbers for every c that a word can hold, each from two shorter runs.
    widest = {1: bits}
    for c in sorted(COUNTS)[1:]:
        half = max(k for k in widest if 2 * k >= c)
        widest[c] = widest[half].copy()
        np.maximum(widest[half][: half - c], widest[half][c - half :], out=widest[c][: half - c])
    pick = np.full(bits.shape, 255, np.uint8)
    for s in reversed(range(len(COUNTS))):
        pick[widest[COUNTS[s]] <= WIDTHS[s]] = s
    pick = pick.reshape(padded.shape)
    if (pick[:, :BLOCK] == 255).any():
        raise ValueError("an id needs more than 60 bits")
    length = np.full(blocks, BLOCK)
    length[-1] = len(ids) - BLOCK * (blocks - 1)
    counts = np.array(COUNTS)
    rows, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    flat_pick, base = pick.reshape(-1), np.arange(blocks) * padded.shape[1]
    n_words = np.zeros(blocks, np.int64)
    while len(rows):
        from_ = base[rows] + at
        s = flat_pick[from_]
        steps.append((rows, from_, s))
        n_words[rows] += 1
        at = at + counts[s]
        going = at < length[rows]
        rows, at = rows[going], at[going]
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(n_words)
    # The k-th step takes the k-th word of each block that is that long.
    first = offsets[:-1].astype(np.int64)
    place = np.concatenate([first[rows] + k for k, (rows, _, _) in enumerate(steps)])
    from_, s = (np.concatenate([x[i] for x in steps]) for i in (1, 2))
    cells, words = padded.reshape(-1), np.empty(len(s), np.uint64)
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        at, word = from_[own], np.full(len(own), int(k) << 60, np.uint64)
        for i in range(COUNTS[k]):
            word |= cells[at + i] << np.uint64(i * WIDTHS[k])
        words[place[own]] = word
    return words, offsets


def decode_ids(words, offsets, n: int):
    """The n ids, all blocks at once."""
    import numpy as np

    out = np.zeros(n, np.uint64)
    if not n:
        return out
    s = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[s]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    start = before - before[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        mask = np.uint64((1 << WIDTHS[k]) - 1)
        cells = (words[own][:, None] >> (np.arange(COUNTS[k], dtype=np.uint64) * np.uint64(WIDTHS[k]))) & mask
        place = start[own][:, None] + np.arange(COUNTS[k])
        good = place < end[own][:, None]
        out[place[good]] = cells[good]
    return out


def write_image(docs: list[tuple]) -> bytes:
    """One image of (doc id or None, ids as little-endian unsigned 32-bit bytes)."""
    import numpy as np

    words, offsets = encode_ids(np.frombuffer(b"".join(ids for _, ids in docs), "<u4"))
    head = np.array([MAGIC, BLOCK, len(docs), len(offsets) - 1, len(words), sum(len(ids) for _, ids in docs) // 4], "<u8")
    return b"".join([
        head.tobytes(), np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([len(ids) // 4 for _, ids in docs], "<u8").tobytes(),
        np.array([d is None for d, _ in docs], "u1").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def read_image(image: bytes) -> list[tuple]:
    """The documents that write_image was given."""
    import numpy as np

    magic, block, n_docs, n_blocks, n_words, n_ids = np.frombuffer(image, "<u8", 6).tolist()
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not an image of this format")
    at, parts = 48, []
    for kind, n in (("<i8", n_docs), ("<u8", n_docs), ("u1", n_docs), ("<u4", n_blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(image, kind, n, at))
        at += parts[-1].nbytes
    docs, lengths, absent, offsets, words = parts
    ids = decode_ids(words, offsets, n_ids).astype("<u4")
    ends = np.cumsum(lengths).tolist()
    return [(None if gone else d, ids[e - n : e]) for d, n, gone, e in zip(docs.tolist(), lengths.tolist(), absent.tolist(), ends)]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Images of all documents in ascending id order, written to the shared folder and read back as
    (part, seq, n_ids, image); parts and, in them, seqs ascend with the document ids.

    The container is Parquet, so that Spark's own committer places whole files on any store and drops what
    lost executors left. Null ids come first, equal ids in the order of their texts. Null and empty texts
    have end_id alone; no rows give no images. Other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def images(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0
        encoder, end = Encoder.shared(tokenizer), end_id.to_bytes(4, "little")

        def image():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([count], pa.int64()), pa.array([write_image(held)], pa.binary())], names=["part", "seq", "n_ids", "image"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc, encoder.encode(text.as_py()) + end))
                count += len(held[-1][1]) // 4
                if count >= IMAGE_IDS:
                    yield image()
                    seq, held, count = seq + 1, [], 0
        if held:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(images, "part int, seq int, n_ids long, image binary"), "tokens")


def read_token_files(images: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the images; start counts all ids before it,
    and the ids stay behind if they aren't asked for.

    Offsets come from the images' own counts: summed by part first, so that the one running sum over
    everything has a row for each part only.
    """
    sizes = images.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = parts.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("base"))
    inner = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inner.join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))

    def decoded(batches):
        import zlib

        for batch in batches:
            for part, seq, _, image in zip(*[c.to_pylist() for c in batch.columns]):
                held, at, weight = [], 0, 0
                for doc, ids in read_image(image):
                    held.append((doc, part, seq, at, len(ids), zlib.crc32(ids), ids.tobytes() if with_ids else None))
                    at, weight = at + len(ids), weight + (ids.nbytes if with_ids else 64)
                    if weight > 1 << 22:
                        yield _rows(held)
                        held, weight = [], 0
                if held:
                    yield _rows(held)

    def _rows(held):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32", "ids"])

    rows = images.mapInArrow(decoded, "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long, ids binary")
    out = rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
