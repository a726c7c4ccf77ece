"""References to vertices that do not exist: missing, deleted or written only later.

A Bloom filter over the parent keys (in sections of bounded size, see `functions.bloom`) is sent along and proves most orphans at the scan:
what it rejects is certainly missing. Only what it lets pass is joined exactly, to one row per parent. The few references to parents that were ever deleted
are then judged against the writes: both are sorted over range partitions, which split any vertex's history and any moment, with the state carried from one into the next.

Cases: a null id is no reference; null and empty tenants are `default`; op null means PUT; only PUT requests refer; a reference without a time can
be missing but not late or deleted; a write without a time makes its vertex known from the start and is never its last write; of writes at one
time the one with the highest write_id is last; repeated requests give one row per verdict; an empty parent table makes every reference missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlgraph.functions.bloom import MAX_BITS, bloom_of
from marlgraph.functions.canonical import canonical_op, canonical_tenant
from marlgraph.functions.skew import join_skewed
from marlgraph.runtime import materialize

KEY = ["tenant_id", "node_id"]


def references(edge_writes: DataFrame) -> DataFrame:
    """(request_id, endpoint, tenant_id, node_id, requested_at), one row per id that a PUT names."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source_id").alias("node_id")), F.struct(F.lit("target").alias("endpoint"), F.col("target_id").alias("node_id"))))
    rows = edge_writes.where(canonical_op("op") == "PUT").select("request_id", canonical_tenant("tenant_id").alias("tenant_id"), "requested_at", ends.alias("e"))
    return rows.select("request_id", "e.endpoint", "tenant_id", "e.node_id", "requested_at").where("node_id IS NOT NULL")


def orphans(edge_writes: DataFrame, vertex_writes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(request_id, endpoint, tenant_id, requested_at, kind), distinct; kind is missing, late or deleted."""
    writes = vertex_writes.where("node_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "node_id", F.col("written_at").alias("at"), "write_id", (canonical_op("op") == "DELETE").alias("removed"))
    parents = materialize(writes.groupBy(*KEY).agg(F.min(F.when(F.col("at").isNull(), F.lit(None)).otherwise(F.col("at"))).alias("first_at"), F.max(F.col("at").isNull()).alias("always"), F.max("removed").alias("ever_removed")), "parents")
    tested = tested_references(edge_writes, parents, bits)
    out = ["request_id", "endpoint", "tenant_id", "requested_at", "kind"]
    missing = tested.where("NOT maybe").withColumn("kind", F.lit("missing")).select(*out)

    judged = join_skewed(tested.where("maybe"), parents, KEY)
    verdict = (
        F.when(F.col("ever_removed").isNull(), "missing")
        .when(~F.col("always") & (F.col("first_at") > F.col("requested_at")), "late")
        .when(F.col("ever_removed") & F.col("requested_at").isNotNull(), "ask")
    )
    judged = materialize(judged.withColumn("kind", verdict).where("kind IS NOT NULL").select(*out, "node_id"), "judged")
    deleted = _removed_at(judged.where("kind = 'ask'").drop("kind"), writes.join(parents.where("ever_removed").select(*KEY), KEY, "left_semi"))
    return missing.unionByName(judged.where("kind <> 'ask'").select(*out)).unionByName(deleted.withColumn("kind", F.lit("deleted")).select(*out)).distinct()


def tested_references(edge_writes: DataFrame, parents: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """The references with `maybe`: false where the filter proves that the parent is missing."""
    hashed = F.xxhash64(*KEY)
    bloom = bloom_of(parents.select(hashed.alias("h")), "h", parents.count(), bits)
    return references(edge_writes).withColumn("maybe", bloom.might_contain(hashed))


def _removed_at(refs: DataFrame, writes: DataFrame) -> DataFrame:
    """References whose parent's last write at or before requested_at is a removal."""
    told = refs.select(*KEY, F.col("requested_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("write_id"), F.lit(None).cast("boolean").alias("removed"), "request_id", "endpoint")
    marks = writes.where("at IS NOT NULL").select(*KEY, "at", F.lit(0).alias("side"), "write_id", "removed", F.lit(None).cast("long").alias("request_id"), F.lit(None).cast("string").alias("endpoint"))
    order = ["at", "side", "write_id"]  # writes before references of the same time
    rows = materialize(marks.unionByName(told), "marks")
    rows = materialize(rows.repartitionByRange(*KEY, *order, "request_id", "endpoint").withColumn("slot", F.spark_partition_id()), "sorted")
    # the state with which each range of a vertex begins; at most a row for each vertex and range
    last = rows.groupBy(*KEY, "slot").agg(F.max_by("removed", F.when(F.col("side") == 0, F.struct("at", "write_id", "removed"))).alias("closing"))
    before = Window.partitionBy(*KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("closing", ignorenulls=True).over(before)).select(*KEY, "slot", "carried")
    within = Window.partitionBy(*KEY, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = rows.withColumn("within", F.last("removed", ignorenulls=True).over(within)).where("side = 1")
    return state.join(carried, [*KEY, "slot"]).where(F.coalesce("within", "carried")).withColumnRenamed("at", "requested_at")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table end and month of requested_at."""
    return found.groupBy("endpoint", "kind", F.date_format("requested_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"), F.countDistinct("request_id").alias("requests"))
