"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tempora.functions.lineage import materialize, release


#: Rows of a key from which on it is looked up in a broadcast table.
HOT = 1 << 18
#: Rows of the last round for each task that makes rows distinct.
TASK = 1 << 18


def _least(edges: DataFrame, key: str) -> DataFrame:
    """edges with m, the least v of a node, for the node in the column key; null if the node has no lesser neighbour.

    Nodes of many rows are looked up in a broadcast table, as a join by key would gather all their rows in one task.
    """
    least = edges.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("m"))
    hot = materialize(edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key), "hot")
    if hot.isEmpty():
        return edges.join(least, key, "left")
    rest = edges.join(F.broadcast(hot), key, "left_anti").join(least, key, "left")
    few = materialize(hot.join(least, key, "left"), "hot")  # one row for HOT edges at most
    return rest.unionByName(edges.join(F.broadcast(few), key))


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step on edges u > v: neighbours (large: the greater ones) move to the least neighbour of each node."""
    if large:
        out = _least(edges, "v").select("u", F.coalesce("m", "v").alias("v"))
    else:
        out = _least(edges, "u")
        out = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(out.where(F.col("v") == F.col("m")).select("u", "v"))
    return out.repartition(parts, "u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns u, v for edges u > v: each linked node but the least of its component, and that least node.

    Rounds grow with the logarithm of the nodes. No step gathers a node's neighbours: minima are
    combined before the shuffle, and hot nodes are looked up where their edges are.
    """
    edges = materialize(edges, "links")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1)))).first()

    was = mark(edges)
    while was[0]:
        parts = -(-was[0] // TASK)
        moved = materialize(_star(edges, True, parts), "stars")
        old, edges = edges, materialize(_star(moved, False, parts), "stars")
        release(old, moved)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges
