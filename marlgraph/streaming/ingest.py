"""Ingestion of event streams into append-only logs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlgraph.sources.wire import to_wire


def append_to_log(stream: DataFrame, path: str, checkpoint: str, partition_keys: tuple[str, ...] = ("src_table", "primary_key"), trigger: dict | None = None):
    """Appends a stream to a parquet log, the changes of a key in one file per micro-batch. The file sink's own log makes replays harmless."""
    rows = stream.repartition(*partition_keys) if partition_keys else stream
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def publish(events: DataFrame, path: str) -> tuple[int, str | None]:
    """Appends a batch of events to a log: (number accepted, None), or (0, what failed). Counted while writing, and nothing is visible unless all is."""
    seen = Observation("published")
    try:
        events.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        return seen.get["n"], None
    except Exception as x:  # noqa: BLE001 - told to the caller, as the contract has it
        return 0, str(x).split("\n")[0]


def publish_all(batches: Iterable[DataFrame], path: str) -> tuple[int, str | None]:
    """Appends one batch after another and stops at the first that fails: (number accepted so far, what failed or None). What was accepted stays."""
    accepted = 0
    for batch in batches:
        count, why = publish(batch, path)
        if why is not None:
            return accepted, why
        accepted += count
    return accepted, None


#: What makes a Kafka writer wait for all replicas and write each record once. Fixed values.
KAFKA_WRITER = {"kafka.acks": "all", "kafka.enable.idempotence": "true"}


def to_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Writes events to Kafka, batch or stream, keyed by table and primary key; a stream's query is returned. Needs the Kafka connector on the class path."""
    records = to_wire(events)
    options = KAFKA_WRITER | {"kafka.bootstrap.servers": servers, "topic": topic}
    if not events.isStreaming:
        records.write.format("kafka").options(**options).save()
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint")
    return records.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_repeats(stream: DataFrame, keys: tuple[str, ...] = ("src_table", "primary_key", "lsn"), event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each identifier once, by Spark's own state. Without a delay the state never expires; with one, copies further apart than it may both pass."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def dispatch(stream: DataFrame, checkpoint: str, handlers: dict[str, Callable[[DataFrame, int], None]], trigger: dict | None = None):
    """Hands the rows of each table to its handler, per micro-batch; tables without one are counted under `other` if that handler exists."""

    def each(batch: DataFrame, number: int) -> None:
        from marlgraph.runtime import materialize

        rows = materialize(batch, "batch")
        for name, handle in handlers.items():
            if name != "other":
                handle(rows.where(F.upper("src_table") == name.upper()), number)
        if "other" in handlers:
            handlers["other"](rows.where(~F.coalesce(F.upper("src_table").isin([n.upper() for n in handlers if n != "other"]), F.lit(False))), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
