"""Bounded breadth-first search by levels: one join per level instead of one lookup per vertex.

The order is that of a first-in-first-out queue: a level's vertices follow the rank of the vertex that reached them first, out before in,
each by id. With a cap, the lowest ranks of a level are taken by a distributed top-n, so what is ranked on one task is at most the cap.
Without a cap no ranks exist and every level stays distributed. Each level is written to the shared folder, which cuts the lineage.

Cases: depth 0 is the anchor alone; a cap of 0 gives no rows; an anchor without edges has empty lists; loops and repeated edges don't matter;
direction is read in any case, and what is neither inbound nor outbound means both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlgraph.operators.store import both_ends, neighbour_lists
from marlgraph.runtime import materialize


#: Vertices of a frontier that are named one by one in the condition on the edges; a larger one is given by its bounds.
NAMED = 500


def _steps(edges: DataFrame, tenant_id: str, direction: str) -> DataFrame:
    return both_ends(edges.where(F.col("tenant_id") == tenant_id), direction).select("node_id", "dir", "other")


def _steps_from(level: DataFrame, low: int, high: int, count: int, edges: DataFrame, tenant_id: str, direction: str) -> DataFrame:
    """The steps that a frontier can take: its ids, or their bounds, reach the scan of the edges, so that others aren't shuffled, nor read where edges are sorted."""
    ids = [r[0] for r in level.select("node_id").collect()] if count <= NAMED else None
    near = lambda c: (F.col(c).between(low, high) if ids is None else F.col(c).isin(ids))
    ends = {"outbound": near("src"), "inbound": near("dst")}.get(direction.lower(), near("src") | near("dst"))
    return _steps(edges.where(ends), tenant_id, direction).where(near("node_id"))


def expand(edges: DataFrame, anchor: int, max_depth: int, max_nodes: int | None = None, direction: str = "Outbound", tenant_id: str = "default") -> DataFrame:
    """(node_id, depth, rank) of the vertices visited; rank is null without a cap. Repeated edges needn't be removed before.

    Every level reads the edges anew and keeps those of the frontier by a condition on their columns, so edges that are costly to derive should be a written table, best one sorted by its ends.
    """
    spark = edges.sparkSession
    shape = "node_id long, depth int, rank long"
    if max_nodes is not None and max_nodes <= 0:
        return spark.createDataFrame([], shape)
    visited = spark.createDataFrame([(anchor, 0, 0 if max_nodes is not None else None)], shape)
    level, count, size, low, high = visited, 1, 1, anchor, anchor
    for depth in range(1, max_depth + 1):
        steps = _steps_from(level, low, high, size, edges, tenant_id, direction)
        reached = level.join(steps, "node_id").select(F.col("other").alias("node_id"), F.struct(F.col("rank").alias("parent"), "dir", "other").alias("way"))
        fresh = reached.join(visited.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.min("way").alias("way"))
        if max_nodes is not None:
            fresh = fresh.orderBy("way").limit(max_nodes - count)
            rank = F.row_number().over(Window.orderBy("way")) - 1 + count
            fresh = fresh.select("node_id", F.lit(depth).alias("depth"), rank.cast("long").alias("rank"))
        else:
            fresh = fresh.select("node_id", F.lit(depth).alias("depth"), F.lit(None).cast("long").alias("rank"))
        level = materialize(fresh, "level")
        size, low, high = level.agg(F.count("*"), F.min("node_id"), F.max("node_id")).first()
        if not size:
            break
        count += size
        visited = visited.unionByName(level)
        if max_nodes is not None and count >= max_nodes:
            break
    return visited


def with_neighbours(visited: DataFrame, edges: DataFrame, direction: str = "Outbound", tenant_id: str = "default") -> DataFrame:
    """The visited vertices with their sorted neighbour lists, in segments; the side that the direction leaves out is empty."""
    steps = _steps(edges, tenant_id, direction).join(visited.select("node_id"), "node_id", "left_semi")
    return with_lists(visited, neighbour_lists(steps, ["node_id"]))


def with_lists(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """Each vertex with its lists; one without has a segment 0 of empty ones."""
    empty = F.array().cast("array<long>")
    return asked.join(lists, "node_id", "left").withColumns({"segment": F.coalesce("segment", F.lit(0)), "out_edges": F.coalesce("out_edges", empty), "in_edges": F.coalesce("in_edges", empty)})
