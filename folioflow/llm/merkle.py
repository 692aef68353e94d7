"""Merkle manifest of a table: a tree for every group, and one over the groups' roots (operator 11).

Nodes are rows (group, idx, node). At every level they are joined with themselves at computed sibling indices, which
gives each node what stands left and right of it in its run of `fan`; the rows in slot zero emit the parents. Levels are
stored, so each is made once. Proofs go the other way: a node's path is its own siblings and then its parent's path, an
equijoin in which a parent meets `fan` rows at most, so nothing grows with the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "array<struct<left:binary,right:binary>>"


def _hash(*parts: Column) -> Column:
    """The digest, as 32 bytes, of digests given as bytes; what is hashed is their lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def hex_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf(*values: Column) -> Column:
    """The leaf of a row: every value as its UTF-8 byte count, a colon and itself, or as - if null."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, step: _hash(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, left to right, as one binary."""
    return F.aggregate(path, F.lit(b""), lambda done, step: F.concat(done, step["left"], step["right"]))


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with idx, their place in their group by order, and members, its row count. Rows are dealt by ranges of group
    and order, so a large group lies in many partitions, and counted from its partitions' own counts."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = rows.columns
    # Equal rows are told apart, or all of them would be one partition.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("grp").asc(), *order, F.col("tie").asc()]
    placed = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("tie"), "ranked")
    runs = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    up_to, whole = F.sum("here").over(Window.partitionBy("grp").orderBy("part")), F.sum("here").over(Window.partitionBy("grp"))
    runs = runs.select("grp", "part", (up_to - F.col("here") - F.col("first")).alias("shift"), whole.alias("members"))
    return placed.join(runs, ["grp", "part"]).select(*columns, (F.col("at") + F.col("shift")).alias("idx"), "members")


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes with left and right, the digests of the run's others before and after them."""
    slot = F.col("idx") % fan
    others = nodes.select("grp", F.col("idx").alias("sibling"), "node")
    out, found = nodes, []
    for step in range(1, fan):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if fan == 2 else F.col("idx") - slot + (slot + step) % fan
        name = f"other{step}"
        out = out.withColumn("sibling", place).join(others.withColumnRenamed("node", name), ["grp", "sibling"], "left").drop("sibling")
        found.append(F.struct(place.alias("place"), F.col(name).alias("node")))
    run = F.array_sort(F.filter(F.array(*found), lambda x: x["node"].isNotNull()))

    def joined(kept: Column) -> Column:
        return F.aggregate(kept, F.lit(b""), lambda done, x: F.concat(done, x["node"]))

    left, right = F.filter(run, lambda x: x["place"] < F.col("idx")), F.filter(run, lambda x: x["place"] > F.col("idx"))
    return out.select(*nodes.columns, joined(left).alias("left"), joined(right).alias("right"))


def _climb(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees, each with siblings, and (grp, level, node) of the groups' roots. leaves have grp,
    idx, node and members, and may have more, which stays at their level."""
    levels, roots, nodes, level = [], [], leaves, 0
    most = leaves.agg(F.max("members")).first()[0] or 0
    while True:
        roots.append(nodes.where("members = 1").select("grp", F.lit(level).alias("level"), "node"))
        if most <= 1:
            break
        linked = stored(_with_siblings(nodes.where("members > 1"), fan), "merkle")
        release(linked.sparkSession)
        levels.append(linked)
        up = linked.where(F.col("idx") % fan == 0)
        nodes = up.select("grp", F.expr(f"idx div {fan}").alias("idx"), _hash("left", "node", "right").alias("node"), F.expr(f"(members + {fan - 1}) div {fan}").alias("members"))
        most, level = -(-most // fan), level + 1
    made = roots[0]
    for more in roots[1:]:
        made = made.unionByName(more)
    return levels, made


def _descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, fan: int) -> DataFrame:
    """leaves with path and with what else roots (grp, level, path, ...) have; a root's path is what leads on from it."""
    given = [c for c in roots.columns if c not in ("grp", "level", "node", "path")]

    def ended(level: int) -> DataFrame:
        return roots.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", *given)

    above = ended(len(levels))
    for level in reversed(range(1, len(levels))):
        above = _extended(levels[level], above, fan, ["grp", "idx"], given).unionByName(ended(level))
    own = [c for c in leaves.columns if c not in ("idx", "members")]
    alone = leaves.where("members = 1").join(roots.where("level = 0").drop("level", "node"), "grp").select(*own, "path", *given)
    return alone if not levels else _extended(levels[0], above, fan, own, given).unionByName(alone)


def _extended(nodes: DataFrame, above: DataFrame, fan: int, own: list[str], given: list[str]) -> DataFrame:
    up = above.select("grp", F.col("idx").alias("parent"), F.col("path").alias("rest"), *given)
    step = F.array(F.struct("left", "right"))
    return nodes.withColumn("parent", F.expr(f"idx div {fan}")).join(up, ["grp", "parent"]).select(*own, F.concat(step, "rest").alias("path"), *given)


def manifest(docs: DataFrame, more: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", fan: int = FAN) -> DataFrame:
    """A row for every row of docs: id_col, leaf, subroot, root (32 bytes each), path (an array of left and right siblings,
    from the leaf to the root) and the columns of `more`, expressions over docs.

    Leaves are in groups by group_col, a null group coming first, and ascend by id, nulls first; rows of one id go by their
    leaf, and equal rows are leaves of their own. Empty texts are values like others. No rows give no rows. Other columns,
    whatever their names, are ignored.
    """
    extra = {f"more_{k}": c for k, c in enumerate((more or {}).values())}
    group = F.col(f"`{group_col}`").cast("string")
    grouped = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group))
    values = [F.col(f"`{f}`") for f in fields]
    rows = stored(docs.select(grouped.alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf(*values).alias("node"), *[c.alias(n) for n, c in extra.items()]), "leaves")
    leaves = _ranked(rows, [F.col("id").asc_nulls_first(), F.col("node").asc()])
    levels, tops = _climb(leaves, fan)
    # Groups are leaves of the tree above, in one group of their own.
    heads = _ranked(stored(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "level", "node"), "heads"), [F.col("of").asc()])
    head_levels, head_tops = _climb(heads, fan)
    empty = F.array().cast(_NO_PATH)
    over = _descend(heads, head_levels, head_tops.select("grp", "level", "node", empty.alias("path"), F.col("node").alias("root")), fan)
    starts = over.select(F.col("of").alias("grp"), "level", "node", "path", F.col("node").alias("subroot"), "root")
    out = _descend(leaves, levels, stored(starts, "heads"), fan)
    return out.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(n).alias(given) for n, given in zip(extra, more or {})])
