"""Vertices, edges and pointer paths as append-only logs, and the views over them.

Logs: vertices (tenant_id, node_id, properties, op, seq), edges (tenant_id, src, dst, properties, op, seq), pointer paths
(tenant_id, node_id, path, sap_key, seq). op is PUT or DELETE (null: PUT); the highest seq of a key decides, of equal ones a DELETE and then a fixed
order of properties. A log may also have `source` and, with it, `written`: seq then is an order within a source only, and of the sources' last writes the one written last decides. It may have
`puts`, the number of puts that a compacted row stands for. Properties are replaced as a whole. Null ids are left out; null tenants are `default`; empty logs give empty views.

Adjacency is kept as rows; lists are only built for output, in segments of bounded length. A tombstone removes an edge from both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.functions.canonical import canonical_op, canonical_tenant
from marlgraph.operators.heavy_keys import SEGMENT, segmented

#: Degree from which a vertex is reported as a super-node. On reading, on compaction.
SUPER_READ, SUPER_FOLD = 500_000, 1_000_000
SEPARATOR = "\x1f"


VERTEX, EDGE, PATH = ["tenant_id", "node_id"], ["tenant_id", "src", "dst"], ["tenant_id", "path", "node_id"]
#: Values of each log.
VALUES = {"vertices": (VERTEX, ["properties"]), "edges": (EDGE, ["properties"]), "paths": (PATH, ["sap_key"])}


def _last(log: DataFrame, keys: list[str], values: list[str], carried: list[str] = ()) -> DataFrame:
    """(keys, last): the last write of each key, as (removed, values, seq, carried)."""
    rows = log.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys if k != "tenant_id"))).withColumn("tenant_id", canonical_tenant("tenant_id"))
    removed = (canonical_op("op") == "DELETE" if "op" in log.columns else F.lit(False)).alias("removed")
    tie = F.xxhash64(*[F.sort_array(F.map_entries(v)) if isinstance(log.schema[v].dataType, T.MapType) else F.col(v) for v in values])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(removed, *values, "seq", *carried), F.struct("seq", removed, tie)).alias("last"), F.sum(_puts(log)).alias("puts"))


def _puts(log: DataFrame) -> Column:
    one = F.when(canonical_op("op") == "PUT", 1).otherwise(0) if "op" in log.columns else F.lit(1)
    return (F.coalesce("puts", one) if "puts" in log.columns else one).cast("long")


def _latest(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    if "source" in log.columns:
        by_source = _last(log if "written" in log.columns else log.withColumn("written", F.lit(0)), [*keys, "source"], values, ["written"])
        rows = by_source.groupBy(*keys).agg(F.max_by("last", F.struct("last.written", "last.seq")).alias("last"))
    else:
        rows = _last(log, keys, values)
    return rows.where("NOT last.removed").select(*keys, *[f"last.{v}" for v in values], "last.seq")


def compacted(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The log with one row for each key and source, its last write. Tombstones stay, since an older put may still arrive, and `puts` counts the puts that a row stands for."""
    rows = _last(log, [*keys, "source"], values, ["written"])
    return rows.select(*keys, *[f"last.{v}" for v in values], F.when(F.col("last.removed"), "DELETE").otherwise("PUT").alias("op"), "last.seq", "source", "last.written", "puts")


def latest_vertices(log: DataFrame) -> DataFrame:
    return _latest(log, *VALUES["vertices"])


def latest_edges(log: DataFrame) -> DataFrame:
    """One row per (tenant_id, src, dst) that exists."""
    return _latest(log, *VALUES["edges"])


def latest_pointer_paths(log: DataFrame) -> DataFrame:
    return _latest(log, *VALUES["paths"])


def scan_vertices(vertices: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's vertices from id 0 on, in ascending order of id."""
    return vertices.where((F.col("tenant_id") == tenant_id) & (F.col("node_id") >= 0)).orderBy("node_id")


def get_vertex(vertices: DataFrame, tenant_id: str, node_id: int) -> DataFrame:
    return vertices.where((F.col("tenant_id") == tenant_id) & (F.col("node_id") == node_id))


def get_edge(edges: DataFrame, tenant_id: str, src: int, dst: int) -> DataFrame:
    return edges.where((F.col("tenant_id") == tenant_id) & (F.col("src") == src) & (F.col("dst") == dst))


def both_ends(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(tenant_id, node_id, dir, other): dir 0 is out, 1 is in. direction: outbound, inbound, or else both."""
    if direction.lower() in ("outbound", "inbound"):
        near, far, d = ("src", "dst", 0) if direction.lower() == "outbound" else ("dst", "src", 1)
        return edges.select("tenant_id", F.col(near).alias("node_id"), F.lit(d).alias("dir"), F.col(far).alias("other"))
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("dir"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("dir"), F.col("src").alias("other")))
    return edges.select("tenant_id", F.explode(ends).alias("e")).select("tenant_id", "e.*")


def neighbour_lists(ends: DataFrame, keys: list[str], segment: int = SEGMENT) -> DataFrame:
    """(keys, segment, out_edges, in_edges): the sorted distinct `other` of both directions, cut after every `segment` of them.

    A vertex with fewer neighbours has one row, segment 0; a hub has as many as it needs, and no task ever holds its whole list.
    """
    # a key has at most one row for each direction and segment
    one = lambda d: F.coalesce(F.max(F.when(F.col("dir") == d, F.col("values"))), F.array().cast("array<long>"))
    return segmented(ends, [*keys, "dir"], "other", segment).groupBy(*keys, "segment").agg(one(0).alias("out_edges"), one(1).alias("in_edges"))


def neighbours(edges: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(tenant_id, node_id, segment, out_edges, in_edges) of every vertex; see neighbour_lists."""
    return neighbour_lists(both_ends(edges), ["tenant_id", "node_id"], segment)


def degrees(edge_log: DataFrame) -> DataFrame:
    """(tenant_id, node_id, degree, out_degree, in_degree) counting every put at each end, repeats included; compacted rows count for the puts they stand for, tombstones for none."""
    rows = edge_log.where("src IS NOT NULL AND dst IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "src", "dst", _puts(edge_log).alias("n")).where("n > 0")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("n").alias("out"), F.lit(0).cast("long").alias("in")), F.struct(F.col("dst").alias("node_id"), F.lit(0).cast("long").alias("out"), F.col("n").alias("in"))))
    rows = rows.select("tenant_id", ends.alias("e")).groupBy("tenant_id", "e.node_id")
    return rows.agg(F.sum(F.col("e.out") + F.col("e.in")).alias("degree"), F.sum("e.out").alias("out_degree"), F.sum("e.in").alias("in_degree"))


def super_nodes(degree: DataFrame, threshold: int = SUPER_READ) -> DataFrame:
    return degree.where(F.col("degree") > threshold)


def merge_runs(runs: DataFrame) -> DataFrame:
    """(tenant_id, node_id, other) of adjacency kept in overlapping segments: their union, as rows."""
    rows = runs.where("node_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "node_id", F.explode("out_edges").alias("other"))
    return rows.where("other IS NOT NULL").distinct()


def shard(source: str | Column, shards: int) -> Column:
    """The shard of an edge: all out-edges of a source share one."""
    return F.pmod(F.xxhash64(source), F.lit(shards))


def path_key(path: str | Column) -> Column:
    """The path as one sortable string in which a prefix ends at a segment's end; a null segment counts as empty."""
    c = F.col(path) if isinstance(path, str) else path
    return F.concat(F.array_join(c, SEPARATOR, ""), F.when(F.size(c) > 0, SEPARATOR).otherwise(""))


def with_path_key(paths: DataFrame) -> DataFrame:
    """For storing: with this column the prefix filter reaches the scan."""
    return paths.withColumn("path_key", path_key("path"))


def pointer_paths(paths: DataFrame, tenant_id: str, prefix: list[str]) -> DataFrame:
    """Paths of a tenant that begin with the segments, in order of path and id; no segments mean all."""
    rows = paths if "path_key" in paths.columns else with_path_key(paths)
    key = "".join(s + SEPARATOR for s in prefix)
    return rows.where((F.col("tenant_id") == tenant_id) & F.col("path_key").startswith(key)).orderBy("path_key", "node_id").drop("path_key")
