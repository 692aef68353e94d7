"""Finite automata with registers over rows in order, as a prefix scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: Rows, or blocks of the level below, that one row of the next level stands for.
BLOCK = 256


def _state(names: Sequence[str]) -> str:
    return "struct<state:int," + ",".join(f"{n}:int" for n in names) + ">"


def automaton(rows: DataFrame, number: str, event: str, value: str, moves: Sequence[Sequence[tuple[int, str | None]]], registers: Sequence[str]) -> DataFrame:
    """rows with `before`, the state and the registers (null until set) that an automaton is in when it comes to the row.

    number counts the rows from 1 without gaps or repeats. moves[e][s] is (next state, register or None) of event e in state
    s: the register takes the row's value. A row whose event is null moves nothing. It begins in state 0.

    What a run of rows does to each state is worked out for BLOCK rows at a time, and for BLOCK of those, until one is left;
    the states come back down the same way. So no task reads more than its blocks, however long the sequence is, and no
    row waits for the one before.
    """
    kind, places = _state(registers), range(len(moves[0]))
    table = F.array(*[F.array(*[F.struct(F.lit(n).alias("to"), F.lit(r).cast("string").alias("set")) for n, r in row]) for row in moves])
    same = F.array(*[F.struct(F.lit(s).alias("state"), *[F.lit(None).cast("int").alias(r) for r in registers]) for s in places]).cast(f"array<{kind}>")

    def moved(now: Column, row: Column) -> Column:
        move = F.get(F.get(table, row[event].cast("int")), now["state"])
        kept = F.struct(move["to"].alias("state"), *[F.when(move["set"] == r, row[value].cast("int")).otherwise(now[r]).alias(r) for r in registers])
        return F.when(move.isNull(), now).otherwise(kept).cast(kind)

    def joined(now: Column, block: Column) -> Column:
        then = F.get(block["does"], now["state"])
        return F.struct(then["state"].alias("state"), *[F.coalesce(then[r], now[r]).alias(r) for r in registers]).cast(kind)

    def blocks(frame: DataFrame, at: str) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), *[c for c in frame.columns if c != at])))
        return frame.groupBy(F.expr(f"(`{at}` - 1) div {BLOCK} + 1").alias("block")).agg(held.alias("held"))

    def whole(held: Column, step) -> Column:
        """What a block does to every state."""
        return F.aggregate(held, same, lambda done, x: F.transform(done, lambda now: step(now, x)))

    def inside(frame: DataFrame, step) -> DataFrame:
        """The rows of blocks (held, before) with what is before each of them."""
        start = F.struct(F.col("before").cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("all"))
        states = F.aggregate("held", start, lambda done, x: F.struct(step(done["now"], x).cast(kind).alias("now"), F.concat(done["all"], F.array(done["now"])).alias("all")))["all"]
        return frame.select(F.explode(F.arrays_zip(F.col("held").alias("row"), states.alias("before"))).alias("x")).select("x.row.*", "x.before")

    top = rows.agg(F.max(number)).first()[0] or 0
    packed = settled(blocks(rows.select(F.col(number).alias("at"), event, value), "at").select("block", whole(F.col("held"), moved).alias("does")))
    levels = [packed]
    while (top := -(-top // BLOCK)) > 1:
        levels.append(settled(blocks(levels[-1].withColumnRenamed("block", "at"), "at").select("block", whole(F.col("held"), joined).alias("does"))))
    first = F.struct(F.lit(0).alias("state"), *[F.lit(None).cast("int").alias(r) for r in registers]).cast(kind)
    known = levels[-1].select("block", first.alias("before"))
    for level in reversed(levels[:-1]):
        known = inside(blocks(level.withColumnRenamed("block", "at"), "at").join(known, "block"), joined).select(F.col("at").alias("block"), "before")
    out = inside(blocks(rows.withColumnRenamed(number, "at"), "at").join(known, "block"), moved)
    return out.withColumnRenamed("at", number)
