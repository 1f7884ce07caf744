"""Connected components of an undirected edge table.

Contraction over hashed priorities: every node points to its best neighbour (or
itself), pointers are followed twice, edges are rewritten to the pointed-to
nodes and self-loops dropped.  Hashed priorities make the number of rounds
logarithmic even on long chains sorted by id; each round is two equi-joins and
one partially aggregated ``groupBy``, so a hub with a third of all edges is split
by adaptive skew handling instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.plans.scratch import Scratch


def _rank(node: Column) -> Column:
    """Order of nodes: a hash first, the id to break ties."""
    return F.struct(F.xxhash64(node).alias("p"), node.alias("v"))


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge; component = smallest node id.

    Null endpoints and self-loops link nothing.  Nodes without an edge are not
    returned: a left join with ``coalesce(component, node)`` adds them.
    """
    live = scratch.cut(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    owner = None
    for _ in range(max_rounds):
        if not live.take(1):
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("m"))
        own = _rank(F.col("a"))
        step = scratch.cut(best.select(F.col("a").alias("node"), F.when(F.col("m") < own, F.col("m.v")).otherwise(F.col("a")).alias("to")), "step")
        far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = scratch.cut(step.join(far, "to").select("node", F.col("far").alias("to")), "jump")
        hop = lambda name: jumped.select(F.col("node").alias(name), F.col("to").alias(name + "_to"))
        if owner is None:
            new_owner = jumped
        else:
            new_owner = scratch.cut(
                owner.withColumnRenamed("to", "mid").join(hop("mid"), "mid", "left").select("node", F.coalesce("mid_to", "mid").alias("to")), "owner")
        rewritten = live.join(hop("a"), "a").join(hop("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b")
        new_live = scratch.cut(rewritten.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        scratch.drop(step, live)
        if owner is not None:
            scratch.drop(owner, jumped)
        owner, live = new_owner, new_live
    else:
        raise RuntimeError("components did not settle")
    if owner is None:
        return edges.select(F.col(src).alias("node"), F.col(dst).alias("component")).where("false")
    smallest = owner.groupBy("to").agg(F.min("node").alias("component"))
    return scratch.cut(owner.join(smallest, "to").select("node", "component"), "components")
