"""Change events: their schema, readers and the events made from rows.

An event is (src_table, primary_key, operation, before_image, after_image, event_ts, txid, lsn); a value of an image is one of five typed fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

VALUE = T.StructType([T.StructField("string_value", T.StringType()), T.StructField("int_value", T.LongType()), T.StructField("double_value", T.DoubleType()), T.StructField("bool_value", T.BooleanType()), T.StructField("bytes_value", T.BinaryType())])
IMAGE = T.MapType(T.StringType(), VALUE)
EVENT = T.StructType([
    T.StructField("src_table", T.StringType()), T.StructField("primary_key", T.StringType()), T.StructField("operation", T.IntegerType()), T.StructField("before_image", IMAGE),
    T.StructField("after_image", IMAGE), T.StructField("event_ts", T.TimestampType()), T.StructField("txid", T.StringType()), T.StructField("lsn", T.LongType()),
])


def as_value(c: Column, kind: T.DataType) -> Column:
    """A column as a typed value: the field of its type is set, a null leaves all five null. Types without a field become text."""
    at = "bool_value" if isinstance(kind, T.BooleanType) else "int_value" if isinstance(kind, T.IntegralType) else "double_value" if isinstance(kind, (T.FractionalType,)) else "bytes_value" if isinstance(kind, T.BinaryType) else "string_value"
    return F.struct(*[(c.cast(f.dataType) if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name) for f in VALUE.fields])


def value_text(v: Column) -> Column:
    """A typed value as text; bytes as base64, no value as null."""
    return F.coalesce(v["string_value"], v["int_value"].cast("string"), v["double_value"].cast("string"), v["bool_value"].cast("string"), F.base64(v["bytes_value"]))


def insert_events(rows: DataFrame, table: str, keys: list[str], txid: str = "INITIAL_LOAD") -> DataFrame:
    """One insert per row: the key columns joined by |, lsn 1..n in order of the key. Rows with equal keys are numbered in order of their values.

    Numbers come from a range-partitioned sort with the partitions' sizes added up, not from one task.
    """
    image = F.create_map(*[x for f in rows.schema.fields for x in (F.lit(f.name), as_value(F.col(f"`{f.name}`"), f.dataType))])
    made = rows.select(F.lit(table).alias("src_table"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("primary_key"), F.lit(1).alias("operation"), F.lit(None).cast(IMAGE).alias("before_image"), image.alias("after_image"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_row"))
    order = [*[f"_{i}" for i in range(len(keys))], "_row"]
    from marlgraph.runtime import materialize

    placed = materialize(made.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "events")
    sizes = placed.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = placed.withColumn("_n", number).join(F.broadcast(before), "_part")  # a row per partition
    return out.select("src_table", "primary_key", "operation", "before_image", "after_image", F.lit(None).cast("timestamp").alias("event_ts"), F.lit(txid).alias("txid"), (F.col("_n") + F.col("_before")).cast("long").alias("lsn"))


def poll(log: DataFrame, after_lsn: int, limit: int = 1000) -> DataFrame:
    """The next changes of a log in order of lsn: at least `limit` where there are as many, and all of the last lsn, so that going on after it skips none."""
    rest = log.where(F.col("lsn") > after_lsn)
    last = rest.select("lsn").orderBy("lsn").limit(limit).agg(F.max("lsn").alias("_last"))
    return rest.join(F.broadcast(last), F.col("lsn") <= F.col("_last")).drop("_last").orderBy("lsn")


class Poller:
    """Polls a log from where it last got to. The place is kept as numbered commits below `root`, so that of two pollers at once one gets a Conflict and no change is handed out twice as done.

    `take` hands out the next changes; `done` keeps that they are dealt with. Without `done` the next `take`, also that of another process, hands them out again.
    """

    def __init__(self, spark: SparkSession, root: str, limit: int = 1000):
        from marlgraph.runtime import VersionedTable

        self.place, self.limit = VersionedTable(spark, root), limit
        self._number, self._last = 0, None

    @property
    def after(self) -> int:
        """The last lsn that is dealt with; -1 before the first."""
        return self.place.content().get("lsn", -1)

    def take(self, log: DataFrame) -> DataFrame:
        self._number = self.place.head()
        batch = poll(log, self.place.content(self._number).get("lsn", -1), self.limit)
        self._last = batch.agg(F.max("lsn")).first()[0]
        return batch if self._last is None else batch.where(F.col("lsn") <= self._last)

    def done(self) -> None:
        if self._last is not None:
            self.place.publish({"lsn": self._last}, self._number)
            self._last = None


def from_json_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON text; a text that is none is kept in `corrupt` with null fields, so that one bad message stops nothing."""
    shape = T.StructType([*EVENT.fields, T.StructField("corrupt", T.StringType())])
    return raw.select(F.from_json(column, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("e")).select("e.*")


def kafka_events(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", wire: bool = False) -> DataFrame:
    """A stream of events from Kafka, as JSON or in the wire format; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    if wire:
        from marlgraph.sources.wire import from_wire

        return from_wire(raw)
    return from_json_lines(raw.select(F.col("value").cast("string").alias("value")))


def sample_events(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """An endless stream of made-up inserts with rising lsn, for trying things out."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    image = F.create_map(F.lit("MATNR"), as_value(F.lit("MAT-123"), T.StringType()))
    return rate.select(F.lit("MARA").alias("src_table"), F.lit("MAT-123").alias("primary_key"), F.lit(1).alias("operation"), F.lit(None).cast(IMAGE).alias("before_image"), image.alias("after_image"), F.col("timestamp").alias("event_ts"), F.format_string("TX%08d", F.col("value") + 1).alias("txid"), (F.col("value") + 1).alias("lsn"))


def edges_of_keys(events: DataFrame) -> DataFrame:
    """The demonstration mapping of keys to edges: n becomes (n, n + 1), a|b becomes (a, b), everything else (1, 2)."""
    parts = F.split("primary_key", r"\|")
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))
    one, two = number(F.col("primary_key")), (number(parts[0]), number(F.get(parts, F.lit(1))))
    pair = F.when(one.isNotNull(), F.struct(one.alias("src"), (one + 1).alias("dst"))).when((F.size(parts) == 2) & two[0].isNotNull() & two[1].isNotNull(), F.struct(two[0].alias("src"), two[1].alias("dst"))).otherwise(F.struct(F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst")))
    return events.select(F.lit("default").alias("tenant_id"), pair.alias("e"), F.when(F.col("operation") == 3, "DELETE").otherwise("PUT").alias("op"), F.col("lsn").alias("seq")).select("tenant_id", "e.src", "e.dst", F.create_map().cast("map<string,string>").alias("properties"), "op", "seq")


def graph_writes(events: DataFrame, catalog, tenant_id: str = "default", codes: dict[str, int] | None = None, width: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(vertex log, edge log) from events by the catalog: a row of a node's table writes its vertex, one of an edge's table the edge between its columns.

    Ids are key * width + code of the label (see Catalog; codes and width may be given), so vertices of different labels never meet. Deletes become tombstones, from the before image
    where there is no after image. An update that moves an edge, or changes a vertex's key, leaves a tombstone at the old place. Keys are whole numbers; other
    values are left out. All mappings are read off a row at once, so either log reads the events once, whatever the size of the catalog.
    """
    codes, width = catalog.codes() if codes is None else codes, width or catalog.width()
    known = events.where(F.col("operation").isin(1, 2, 3))
    now, old = F.coalesce("after_image", "before_image"), F.col("before_image")
    text = lambda image, c: value_text(F.try_element_at(image, F.lit(c)))
    props = T.MapType(T.StringType(), T.StringType())

    def writes(mapping, keys: dict[str, tuple[str, str | None]]) -> Column:
        """What a row of the mapping's table writes: its place now, after a tombstone at the place that it left."""
        at = lambda image: [(text(image, column).try_cast("long") * width + codes.get(label, width - 1)).alias(name) for name, (column, label) in keys.items()]
        named = F.create_map(F.lit("label"), F.lit(mapping.label))
        if mapping.properties:
            named = F.map_concat(named, F.map_filter(F.create_map(*[x for p in mapping.properties for x in (F.lit(p), text(now, p))]), lambda _, v: v.isNotNull()))
        put = F.struct(*at(now), named.alias("properties"), F.when(F.col("operation") == 3, "DELETE").otherwise("PUT").alias("op"))
        left = F.struct(*at(old), F.lit(None).cast(props).alias("properties"), F.lit("DELETE").alias("op"))
        moved = (F.col("operation") == 2) & old.isNotNull() & ~F.struct(*at(old)).eqNullSafe(F.struct(*at(now)))
        return F.when(F.upper("src_table") == mapping.table.upper(), F.when(moved, F.array(left, put)).otherwise(F.array(put)))

    def log(mappings: list[Column], keys: list[str]) -> DataFrame | None:
        if not mappings:
            return None
        each = F.explode(F.flatten(F.filter(F.array(*mappings), lambda w: w.isNotNull()))).alias("w")
        rows = known.select(F.upper("src_table").alias("source"), "lsn", each).where(" AND ".join(f"w.{k} IS NOT NULL" for k in keys))
        return rows.select(F.lit(tenant_id).alias("tenant_id"), *[f"w.{k}" for k in keys], "w.properties", "w.op", F.col("lsn").alias("seq"), "source")

    vertices = [writes(m, {"node_id": (m.id_column, m.label)}) for m in catalog.nodes.values()]
    edges = [writes(m, {"src": (m.source_column, a), "dst": (m.target_column, b)}) for m in catalog.edges.values() for a, b in [catalog.ends_of(m)]]
    return log(vertices, ["node_id"]), log(edges, ["src", "dst"])
