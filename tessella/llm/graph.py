"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v), as a stored table; a component's name is one of its nodes.

    Contraction: in each round every node takes the least of itself and its neighbours as its
    representative, edges are rewritten to representatives, and those that became loops go. Stars and
    cliques are done after one or two rounds. From the third round on the order is another random one
    each time, so that the expected number of nodes shrinks by a constant factor whatever the graph.
    Minima are gathered before rows are dealt out, and representatives are looked up by raw edges, so
    that a node with very many neighbours is no single task's. Nulls are dropped, self-loops keep
    their node.
    """
    e = scratch.put(edges.select("u", "v").filter("u is not null and v is not null"))
    steps: list[DataFrame] = []
    while not (e.isEmpty() if steps else False):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turn = len(steps)
        if turn < 2:
            step = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        else:
            order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("m"))  # noqa: E731, B023
            step = both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least(order("u"), "m")["m"].alias("m"))
        step = scratch.put(step)
        steps.append(step)
        known = few(step)
        ends = e.join(known.select("u", F.col("m").alias("mu")), "u").join(known.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        e = scratch.put(ends.filter("mu != mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
    out = steps[-1].select(F.col("u").alias("node"), F.col("m").alias("component"))
    for step in reversed(steps[:-1]):
        own = step.select(F.col("u").alias("node"), F.col("m").alias("to"))
        later = few(out).select(F.col("node").alias("to"), "component")
        out = scratch.put(own.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")))
    return out
