"""Chains of any length by pointer doubling.

A table of pointers (node, jump) is joined with itself: who jumps to a node jumps where that
one does from then on.  A round doubles the lengths, so a chain of n links is done after
log2(n) rounds, each one join of stored tables, and no session option sets a limit.  What lies
on the way (a length, a name, the least node) is combined in the same join.

Whoever still jumps after more rounds than the table has doublings is on its way into a ring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, scratch, written

Combine = dict[str, Callable[[Column, Column], Column]]


def _doubled(state: DataFrame, combine: Combine, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """The stored state (node, jump, open, ...) once nothing jumps on, or after as many rounds as its rows need or ``rounds``; and whether something still does.

    ``combine`` takes the near and the far value of each other column.
    """
    spark, names = state.sparkSession, list(combine)
    state = written(state, "pointers")
    limit = rounds if rounds is not None else state.count().bit_length() + 1
    with scratch() as made:
        for _ in range(limit):
            far = state.select(F.col("node").alias("jump"), F.col("jump").alias("far_jump"), F.col("open").alias("far_open"), *(F.col(c).alias(f"far_{c}") for c in names))
            met = F.col("far_open").isNotNull()
            joined = state.join(far, "jump", "left")
            state = written(
                joined.select(
                    "node",
                    F.when(met, F.col("far_jump")).otherwise(F.col("jump")).alias("jump"),
                    F.coalesce("far_open", F.lit(False)).alias("open"),
                    *(F.when(met, f(F.col(c), F.col(f"far_{c}"))).otherwise(F.col(c)).alias(c) for c, f in combine.items()),
                ),
                "pointers",
            )
            discard(spark, made[:-1])
            del made[:-1]
            if rounds is None and state.filter("open").isEmpty():
                return state, False
    return state, not state.filter("open").isEmpty()


def _plus(near: Column, far: Column) -> Column:
    return near + far


def chase(edges: DataFrame) -> DataFrame:
    """(node, terminal, depth) of every node of (node, jump), which has one row a node: where its chain ends, and after how many steps.

    A chain that comes to a ring goes round it once and stops before it would meet a node again.
    """
    edges = written(edges.select("node", "jump"), "edges")
    start = edges.withColumn("depth", F.lit(1).cast("long")).withColumn("open", F.lit(True))
    state, looped = _doubled(start, {"depth": _plus})
    done = state.filter("not open").select("node", F.col("jump").alias("terminal"), "depth")
    if not looped:
        return done
    # After so many steps all that are left stand on rings, and a ring is the image of itself.
    on_ring = written(state.filter("open").select(F.col("jump").alias("node")).distinct(), "rings")
    ring = written(edges.join(on_ring, "node", "left_semi"), "ring-edges")
    labelled, _ = _doubled(ring.withColumn("least", F.col("node")).withColumn("open", F.lit(True)), {"least": lambda a, b: F.least(a, b)}, ring.count().bit_length())
    sizes = labelled.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    # The node before each ring node, where a chain that enters there stops.
    stops = labelled.select("node", "least").join(sizes, "least").join(ring.select(F.col("jump").alias("node"), F.col("node").alias("terminal")), "node")
    stops = written(stops.select(F.col("node").alias("entry"), "terminal", "size"), "ring-stops")
    tails = edges.join(state.filter("open").select("node"), "node", "left_semi").join(on_ring, "node", "left_anti")
    into, _ = _doubled(tails.withColumn("depth", F.lit(1).cast("long")).withColumn("open", F.lit(True)), {"depth": _plus})
    entries = into.select("node", F.col("jump").alias("entry"), "depth").unionByName(on_ring.select("node", F.col("node").alias("entry"), F.lit(0).cast("long").alias("depth")))
    return done.unionByName(entries.join(stops, "entry").select("node", "terminal", (F.col("depth") + F.col("size") - 1).alias("depth")))


def forward_closure(forwards: DataFrame) -> DataFrame:
    """(assembly, type_id, terminal, depth): where each forwarded type ends up; a chain that would repeat an assembly stops before it.

    Of several forwards of one type from one assembly, that to the least assembly counts.
    """
    one = forwards.filter("assembly is not null and to_assembly is not null").groupBy("assembly", "type_id").agg(F.min("to_assembly").alias("to_assembly"))
    place = lambda assembly: F.struct(F.col(assembly).alias("assembly"), "type_id")
    found = chase(one.select(place("assembly").alias("node"), place("to_assembly").alias("jump")))
    return found.select("node.assembly", "node.type_id", F.col("terminal.assembly").alias("terminal"), F.col("depth").cast("int").alias("depth"))


def _no_ring(looped: bool) -> None:
    if looped:
        raise ValueError("the parents of some nodes form a ring")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) over a parent column; roots have a null parent.  As many rows as nodes have ancestors.

    After k rounds all distances up to 2^k are there, and those at just 2^k reach on.
    """
    spark, reach = nodes.sparkSession, 1
    with scratch() as made:
        pairs = written(nodes.filter("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
        known = pairs.count()
        parts = [pairs]
        while True:
            ahead = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
            new = parts[-1].filter(F.col("distance") == reach).join(ahead, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
            new = written(new, "ancestors")
            if new.isEmpty():
                discard(spark, made[-1:])
                return pairs
            _no_ring(reach > known)
            parts.append(new)
            pairs = parts[0]
            for p in parts[1:]:
                pairs = pairs.unionByName(p)
            reach *= 2


def qualified_names(nodes: DataFrame) -> DataFrame:
    """(node, qualified, depth): names of a node's ancestors and its own, joined by dots, from columns node, parent and name."""
    start = nodes.select("node", F.col("parent").alias("jump"), F.col("name").alias("qualified"), F.lit(0).alias("depth"), F.lit(True).alias("open"))
    state, looped = _doubled(start, {"qualified": lambda near, far: F.concat(far, F.lit("."), near), "depth": lambda near, far: near + far + 1})
    _no_ring(looped)
    return state.select("node", "qualified", "depth")
