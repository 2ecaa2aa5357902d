"""An adjacency of a snapshot: neighbours in one order, with offsets by vertex, as tables sorted by the anchor.

neighbours has a row for each edge: anchor, neighbor, edge_id and place, in the order of anchor, neighbour and edge; offsets
has a row for each vertex: vertex, first and degree, so that the neighbours of a vertex are the places from first on. Both are
written by ranges of their first column, so a vertex's rows are found by skipping files and row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tempora.functions.lineage import numbered

DIRECTIONS = {"out": ("src", "dst"), "in": ("dst", "src")}


class AdjacencyError(ValueError):
    pass


@dataclass
class Adjacency:
    neighbours: DataFrame
    offsets: DataFrame

    def of(self, vertex: int) -> DataFrame:
        """neighbor, edge_id, place of a vertex that must be there, in order."""
        if self.offsets.where(F.col("vertex") == vertex).isEmpty():
            raise AdjacencyError(f"no vertex {vertex}")
        return self.neighbours.where(F.col("anchor") == vertex).select("neighbor", "edge_id", "place").orderBy("place")

    def expand(self, frontier: DataFrame) -> DataFrame:
        """anchor, neighbor, edge_id of all vertices of a frontier (id)."""
        return self.neighbours.join(frontier.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi").select("anchor", "neighbor", "edge_id")


def build(edges: DataFrame, path: str, direction: str = "out", max_edges: int | None = None) -> Adjacency:
    """Write the adjacency of edges (id, src, dst), each id once, below path. max_edges: more are refused."""
    near, far = DIRECTIONS[direction]
    spark: SparkSession = edges.sparkSession
    rows = edges.select(F.col(near).alias("anchor"), F.col(far).alias("neighbor"), F.col("id").alias("edge_id"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct("edge_id").alias("ids")).first()
    if sizes["n"] != sizes["ids"]:
        raise AdjacencyError("an edge id is repeated")
    if max_edges is not None and sizes["n"] > max_edges:
        raise AdjacencyError(f"{sizes['n']} edges; at most {max_edges}")
    placed = numbered(rows, [F.col("anchor"), F.col("neighbor"), F.col("edge_id")], "place")
    placed.repartitionByRange("anchor", "place").sortWithinPartitions("anchor", "place").write.parquet(f"{path}/neighbours")
    neighbours = spark.read.parquet(f"{path}/neighbours")
    degrees = neighbours.groupBy(F.col("anchor").alias("vertex")).agg(F.count("*").alias("degree"))
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().join(degrees, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).alias("degree"))
    # a vertex without neighbours starts where the next one does
    starts = neighbours.groupBy(F.col("anchor").alias("vertex")).agg(F.min("place").alias("first"))
    ranked = numbered(vertices.join(starts, "vertex", "left"), [F.col("vertex")], "rank")
    filled = _next_start(ranked, sizes["n"])
    filled.repartitionByRange("vertex").sortWithinPartitions("vertex").write.parquet(f"{path}/offsets")
    return Adjacency(neighbours, spark.read.parquet(f"{path}/offsets"))


BLOCK = 4096


def _next_start(ranked: DataFrame, end: int) -> DataFrame:
    """first of vertices without one: that of the next vertex that has one, or the end; found in blocks of ranks."""
    from pyspark.sql import Window as W

    rows = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK))
    near = F.min("first").over(W.partitionBy("block").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))
    far = rows.groupBy("block").agg(F.min("first").alias("least"))
    far = far.withColumn("far", F.min("least").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)))  # a row per block
    return rows.withColumn("near", near).join(far, "block").select("vertex", F.coalesce("near", "far", F.lit(end)).cast("bigint").alias("first"), "degree")


def load(spark: SparkSession, path: str) -> Adjacency:
    return Adjacency(spark.read.parquet(f"{path}/neighbours"), spark.read.parquet(f"{path}/offsets"))
