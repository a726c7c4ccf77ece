"""Per-key results where a few keys hold most rows: counts, degrees and neighbour lists without a long task.

Everything per key is an algebraic SQL aggregate. Spark builds it in a bounded hash map on each partition (which falls back to sorting
and spilling), and only the compact partial states are shuffled. Lists, which can't be compacted, are cut into blocks of target ids: a
block of a key holds at most BLOCK ids, whatever the key holds in all.

Cases: a null key belongs to no group and is left out; null tenants are `default`; null or empty arrays count as nothing, null elements of an array
count as occurrences but are no neighbours; repeated rows count each time for occurrences and once for neighbours; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlgraph.functions.canonical import canonical_tenant

#: Width of a block of target ids as a power of two, and length of a segment of a neighbour list.
BLOCK_BITS = 16
SEGMENT = 1_000


def occurrences(edge_writes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(tenant_id, source_id, n): rows of edge_writes plus elements of out_edges. Arrays count by length, never exploded."""
    rows = edge_writes.where("source_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "source_id", F.lit(1).cast("long").alias("n"))
    runs = adjacency.where("node_id IS NOT NULL AND size(out_edges) > 0").select(canonical_tenant("tenant_id").alias("tenant_id"), F.col("node_id").alias("source_id"), F.size("out_edges").cast("long").alias("n"))
    return rows.unionByName(runs).groupBy("tenant_id", "source_id").agg(F.sum("n").alias("n"))


def heavy_sources(edge_writes: DataFrame, adjacency: DataFrame, percent: int = 1) -> DataFrame:
    """Sources holding at least `percent` of all occurrences, with their counts. The total is a scalar over the same aggregate, whose exchange is reused."""
    counts = occurrences(edge_writes, adjacency)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") * 100 >= total.scalar() * percent)


def edge_pairs(edge_writes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(tenant_id, source_id, target_id) of both tables, repeats kept; null targets are no neighbours."""
    rows = edge_writes.where("source_id IS NOT NULL AND target_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "source_id", "target_id")
    runs = adjacency.where("node_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), F.col("node_id").alias("source_id"), F.explode("out_edges").alias("target_id")).where("target_id IS NOT NULL")
    return rows.unionByName(runs)


def degrees(edge_writes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(tenant_id, source_id, degree, neighbours): occurrences, and distinct non-null targets.

    Repeats of a pair meet in a partial aggregate before the shuffle on the whole pair, so no source is in one task until its pairs are single numbers.
    """
    pairs = edge_pairs(edge_writes, adjacency).groupBy("tenant_id", "source_id", "target_id").agg(F.lit(1).alias("one"))
    distinct = pairs.groupBy("tenant_id", "source_id").agg(F.count("*").alias("neighbours"))
    return occurrences(edge_writes, adjacency).join(distinct, ["tenant_id", "source_id"], "left").select("tenant_id", "source_id", F.col("n").alias("degree"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def segmented(rows: DataFrame, by: list[str], value: str, segment: int = SEGMENT) -> DataFrame:
    """(by, segment, values): the sorted distinct values of each key as lists, cut after every `segment` of them.

    Values are gathered as a set for each key and block, combined before the shuffle, so what moves is lists of at most a block and never a hub's whole one.
    A block's place in its key's list is the number of values in lower blocks, a sum over the blocks' sizes alone. Each block is then cut at the
    segments' borders, and the few pieces of a segment are put together.
    """
    # never null, so that the join adds no filter to one side only and both sides share the exchange of the sets
    block = F.coalesce(F.shiftright(value, BLOCK_BITS), F.lit(0))
    kept = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, value])).select(*by, value, block.alias("_block"))
    sets = kept.groupBy(*by, "_block").agg(F.array_sort(F.collect_set(value)).alias("_values"))
    below = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sets.select(*by, "_block", F.size("_values").alias("_size")).select(*by, "_block", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_before"))
    first, last = (F.floor(x / segment).cast("int") for x in (F.col("_before"), F.col("_before") + F.size("_values") - 1))
    begin = lambda k: F.greatest(k * segment - F.col("_before"), F.lit(0)).cast("int")
    piece = lambda k: F.struct(k.cast("long").alias("segment"), F.col("_block"), F.slice("_values", begin(k) + 1, ((k + 1) * segment - F.col("_before")).cast("int") - begin(k)).alias("_values"))
    pieces = sets.join(before, [*by, "_block"]).select(*by, F.explode(F.transform(F.sequence(first, last), piece)).alias("_p")).select(*by, "_p.*")
    whole = pieces.groupBy(*by, "segment").agg(F.array_sort(F.collect_list(F.struct("_block", "_values"))).alias("_pieces"))
    return whole.select(*by, "segment", F.flatten(F.col("_pieces._values")).alias("values"))


def neighbour_segments(pairs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(tenant_id, source_id, segment, neighbours): the sorted distinct targets of each source, cut after every `segment` of them."""
    return segmented(pairs, ["tenant_id", "source_id"], "target_id", segment).withColumnRenamed("values", "neighbours")
