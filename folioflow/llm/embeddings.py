"""Embedding near-duplicates by randomised-rotation binary codes (operator 8).

Vectors are turned by random rotations and reduced to signs. Runs of sign bits are keys that bring likely
neighbours together; the signs of the first ROTATIONS, with a stored correction factor, estimate an inner
product without bias, and only pairs whose confidence bound reaches the limit are computed exactly.

Vectors within BALL of a leader link with each other by the triangle inequality of angles, so copies are
counted and never paired.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled, short_batches, stored
from .near_dup import apart

LIMIT = 0.9
#: Cosine to a leader at which a vector joins its ball: twice that angle is under the limit's.
BALL = 0.976
ROTATIONS = 4
#: Standard deviations of the estimate's error that the bound allows for.
DEVIATIONS = 5.0
#: A pair at the limit shares no key with this probability, at most.
MISS = 1e-3
SEED = 99


def plan(n: int, limit: float = LIMIT) -> tuple[int, int]:
    """(bits of a key, number of keys) for n vectors: four times as many buckets as vectors, and enough keys."""
    same = 1 - math.acos(limit) / math.pi
    bits = min(48, max(10, math.ceil(math.log2(max(n, 2))) + 2))
    return bits, math.ceil(math.log(1 / MISS) / same**bits)


def rotations(dims: int, bits: int):
    """Random rotations, one after another, that give at least `bits` numbers of a vector."""
    import numpy as np

    rng = np.random.default_rng([SEED, dims])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(max(ROTATIONS, -(-bits // dims)))])


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _cosines(pairs: DataFrame, vectors: DataFrame, least: float, estimate: bool) -> DataFrame:
    """(a, b, cosine) of pairs at `least` or more less the pair's slack angle; the estimate goes first if asked for."""
    side = lambda x: vectors.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("unit", "code", "factor", "dims")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("dims_a = dims_b")
    both = both.select("a", "b", "slack", "unit_a", "unit_b", "code_a", "factor_a", "dims_a")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict = {}
        for batch in batches:
            dims = np.asarray(batch.column(7))
            for d in np.unique(dims):
                b = batch.filter(pa.array(dims == d))
                floor = np.cos(np.minimum(math.acos(least) + np.asarray(b.column(2)), math.pi))
                if estimate:
                    if d not in turns:
                        turns[d] = rotations(int(d), 0)[: ROTATIONS * d]
                    signs = np.unpackbits(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(dims[dims == d]), -1), axis=1)[:, : ROTATIONS * d].astype(np.float32) * 2 - 1
                    factor = np.asarray(b.column(6))
                    about = np.einsum("ij,ij->i", signs, (_matrix(b.column(4)) @ turns[d].T).astype(np.float32)) / (math.sqrt(d) * ROTATIONS * factor)
                    spread = np.sqrt((1 - factor**2) / factor**2 / max(1, d - 1) / ROTATIONS) * np.sqrt(1 - floor**2)
                    # Below ten numbers the normal bound says little, so everything is computed there.
                    near = (about + DEVIATIONS * spread >= floor) | (d < 10)
                    b, floor = b.filter(pa.array(near)), floor[near]
                if len(floor):
                    exact = np.clip(np.einsum("ij,ij->i", _matrix(b.column(3)), _matrix(b.column(4))), -1, 1)
                    keep = exact >= floor
                    yield pa.record_batch([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(exact[keep])], names=["a", "b", "cosine"])

    return both.mapInArrow(run, "a long, b long, cosine double")


def _coded(rows: DataFrame) -> DataFrame:
    """(node, unit, dims, code, factor, mass) of rows (node, embedding, mass)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict = {}
        for b in batches:
            units, codes, factors, dims = [], [], [], []
            for x in b.column(1):
                v = np.asarray(x.values, np.float64)
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
                d = len(v)
                if d not in turns:
                    turns[d] = rotations(d, 0)[: ROTATIONS * d]
                r = turns[d] @ v
                units.append(v.astype("<f8").tobytes())
                codes.append(np.packbits(r >= 0).tobytes())
                factors.append(float(np.abs(r).sum() / (math.sqrt(d) * ROTATIONS)))
                dims.append(d)
            yield pa.record_batch([b.column(0), pa.array(units, pa.binary()), pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(factors, pa.float64()), b.column(2)], names=["node", "unit", "dims", "code", "factor", "mass"])

    return rows.mapInArrow(run, "node long, unit binary, dims int, code binary, factor double, mass long")


def _keys(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, node): for every table, the bits that it takes of the rotated signs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict = {}
        for b in batches:
            dims = np.asarray(b.column(2))
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                if d not in turns:
                    turns[d] = rotations(int(d), bits * tables)[: bits * tables]
                signs = (_matrix(own.column(1)) @ turns[d].T >= 0).reshape(-1, tables, bits)
                keys = signs @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                keys = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(tables, dtype=np.uint64) + np.uint64(1 + d * 4096)) * np.uint64(0xBF58476D1CE4E5B9))
                yield pa.record_batch([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(np.asarray(own.column(0)), tables))], names=["key", "node"])

    return vectors.select("node", "unit", "dims").mapInArrow(run, "key long, node long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many other rows have a cosine of LIMIT or more
    with it in double precision, and the smallest id its links reach.

    Null, empty and zero vectors, and those with null or non-finite numbers, link with nothing; so do vectors
    of different lengths. Equal vectors are one node that counts for all its rows. A null id takes part, is
    never the smallest and never kept. No rows give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    short_batches(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.size(v) > 0
    good = good & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = F.transform(v, lambda x: x + F.lit(0.0))
    known = stored(rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), clean).alias("embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("check", F.hash("embedding")), "vectors")
    known = apart(known)
    nodes = known.where("node IS NOT NULL").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("mass"))
    vectors = stored(_coded(nodes.select("node", "embedding", "mass")), "codes")
    bits, tables = plan(vectors.count())

    keys = _keys(vectors, bits, tables)
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    met = stored(keys.join(groups.select("key", "hub"), "key"), "buckets")
    stars = met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("slack")).distinct()
    tight = settled(_cosines(stars, vectors, BALL, True))
    inner = tight.select(F.col("b").alias("node")).distinct()
    led = tight.join(inner.select(F.col("node").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("node")).agg(F.min_by(F.struct("a", "cosine"), "a").alias("to"))
    balls = vectors.select("node", "mass").join(led, "node", "left").select("node", "mass", F.coalesce("to.a", "node").alias("leader"), F.coalesce("to.cosine", F.lit(1.0)).alias("cosine"))
    balls = stored(balls, "balls")
    leaders = stored(balls.groupBy("leader").agg(F.sum("mass").alias("total"), F.acos(F.min("cosine")).alias("radius")), "leaders")

    shared = met.join(balls.select("node", "leader"), "node").select("key", "leader").distinct()
    pairs = shared.select("key", F.col("leader").alias("a")).join(shared.select("key", F.col("leader").alias("b")), "key").where("a < b").select("a", "b").distinct()
    size = lambda x: leaders.select(F.col("leader").alias(x), F.col("total").alias(f"total_{x}"), F.col("radius").alias(f"radius_{x}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b")
    reach = F.col("radius_a") + F.col("radius_b")
    close = _cosines(sized.select("a", "b", (reach + 1e-9).alias("slack")), vectors, LIMIT, True)
    close = stored(close.join(size("a"), "a").join(size("b"), "b"), "close")
    whole = (F.acos("cosine") + reach < math.acos(LIMIT) - 1e-7) | ((reach == 0) & (F.col("cosine") >= LIMIT))
    every, some = close.where(whole), close.where(~whole & (reach > 0))
    of = lambda x, y: balls.select(F.col("leader").alias(x), F.col("node").alias(y))
    single = some.select("a", "b").join(of("a", "u"), "a").join(of("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("slack"))
    links = stored(_cosines(single, vectors, LIMIT, True).select("a", "b"), "links")

    edges = balls.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).unionByName(every.select("a", "b")).unionByName(links)
    linked = components(edges)
    balls_linked = every.select(F.col("a").alias("leader"), F.col("total_b").alias("more")).unionByName(every.select(F.col("b").alias("leader"), F.col("total_a").alias("more"))).groupBy("leader").agg(F.sum("more").alias("more"))
    mass = lambda x: balls.select(F.col("node").alias(x), F.col("mass").alias("more"))
    nodes_linked = links.join(mass("b"), "b").select(F.col("a").alias("node"), "more").unionByName(links.join(mass("a"), "a").select(F.col("b").alias("node"), "more")).groupBy("node").agg(F.sum("more").alias("some"))
    per = balls.join(leaders, "leader").join(balls_linked, "leader", "left").join(nodes_linked, "node", "left").join(linked, "node", "left")
    per = per.select("node", (F.col("total") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = stored(known.select("vec_id", "node").join(per, "node", "left"), "linked")
    least = out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
