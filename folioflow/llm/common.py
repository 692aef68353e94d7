"""Pieces that every operator of this subpackage shares: scratch space, settled frames, components."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get these modules' functions whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Rows in one Arrow batch to Python. Texts can be long, so batches are kept short.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
    return context.getCheckpointDir()


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch length to ARROW_ROWS, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/folioflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a stored frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/folioflow/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to the cores if it has fewer partitions than there are: one small file would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of frames that nothing refers to any more: it does so when the
    driver collects its garbage, which a driver with little to do may put off for long."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Bytes of rows that a task holds while it packs them, and bytes of one blob before compression.
PACK_HELD, PACK_BLOB = 24 << 20, 192 << 10


def packed(rows: DataFrame) -> DataFrame:
    """(key, blob) of rows whose first column, the key, is an int: the other columns of rows of one key in a task, as
    compressed Arrow streams. A row longer than PACK_BLOB has a blob of its own size."""
    short_batches(rows.sparkSession)
    key = rows.columns[0]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

        def out(held):
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column(0)))
            keys = table.column(0).to_numpy()
            rest = table.drop_columns(table.column_names[0]).combine_chunks()
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy() if pa.types.is_string(c.type) else 8 for c in rest.columns) + np.zeros(len(keys), np.int64)
            weight = np.cumsum(sizes)
            bounds, at = [0], 0
            cuts = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
            for cut in cuts.tolist():
                while at < cut:
                    at = min(cut, max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + PACK_BLOB, "right"))))
                    bounds.append(at)
            blobs = []
            for a, b in zip(bounds, bounds[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=options) as writer:
                    writer.write_table(rest.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            firsts = keys[bounds[:-1]]
            for a in range(0, len(blobs), 64):
                yield pa.record_batch([pa.array(firsts[a : a + 64], pa.int32()), pa.array(blobs[a : a + 64], pa.binary())], names=[key, "blob"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                if size >= PACK_HELD:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return rows.mapInArrow(run, f"{key} int, blob binary")


def unpacked(blob):
    """The rows of one blob as an Arrow table; blob is an Arrow binary scalar."""
    import pyarrow as pa

    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def settled(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder, for small frames inside loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df hasn't got, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key that holds more than one in HEAVY of all rows is heavy; so there are fewer than HEAVY of them.
HEAVY = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined with table, which has each key once, and in `weight` how many of the rows have it. Heavy keys are
    broadcast, as there can't be more than HEAVY, and the others shuffled, so no key gathers its rows in one task.
    weight is dropped. rows are read twice: they should be stored or cheap."""
    found = fresh(rows.join(table.limit(0), key, "left"), "found")[0]
    total = table.agg(F.sum(weight)).first()[0] or 0
    table = table.withColumn(found, F.lit(True))
    heavy, light = table.where(F.col(weight) * HEAVY > total).drop(weight), table.where(F.col(weight) * HEAVY <= total).drop(weight)
    near = rows.join(F.broadcast(heavy), key, "left")
    rest = near.where(F.col(found).isNull()).select(*[F.col(f"`{c}`") for c in rows.columns]).join(light, key, "left")
    return near.where(F.col(found)).unionByName(rest).drop(found)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps: every node links itself to the smallest neighbour
    it sees, until each one hangs on one node that hangs on none. No neighbour list is ever gathered; each step is an
    aggregate and a join, and the joins are merges, so no round sends anything through the driver. Each round is stored,
    and the one before forgotten. Null ends and self links are ignored; no edges give no rows.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b")
        if large:
            both = both.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low.hint("merge"), "a")
        if large:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def stars(pairs: DataFrame) -> bool:
        """Whether no node hangs on two, or on one that hangs itself. a is more than b in every pair, so b is the smallest."""
        ends = pairs.select(F.col("a").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(pairs.select(F.col("b").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 AND hangs > 0").isEmpty()

    pairs = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    left = rounds
    while not stars(pairs):
        if not left:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        left -= 1
        before, pairs = pairs, stored(star(star(pairs, True), False), "pairs")
        forget(before)
        release(pairs.sparkSession)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
