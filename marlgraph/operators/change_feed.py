"""Applying a change feed: the present rows of every table after repeated, late and out-of-order changes.

Every bucket of keys is kept by an embedded DuckDB table with the key as primary key. A change is upserted under the condition that its
sequence is later than the stored one; a delete is stored as a tombstone, so that an older change arriving later cannot bring the row back.
The same upsert first runs on each input partition, so only one row per key and partition is shuffled and no key can fill a task.
A bucket begins with the rows and tombstones that the table has of it; the buckets that a feed touches are exported and published together by one commit, the others stay
as they are. So feeds may come in any number, split and order. The number of buckets is kept by the table and doubles as it grows, which bounds a bucket's memory.

Cases: operation 1 and 2 set the row whatever was there, 3 deletes it, 0, null and unknown codes change nothing; rows with a null key or
sequence name no change and are left out (they are counted by `rejected`); of changes with the same sequence the higher operation code and
then the greater payload wins, so the result doesn't depend on arrival; an empty feed gives an empty table; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.runtime import BucketedTable, scratch_path, shared_dir, ship

INSERT, UPDATE, DELETE = 1, 2, 3
#: Keys that one upsert table of an input partition holds before its states are passed on and a new one begins.
STATES = 500_000
#: Rows gathered for one upsert statement.
ROWS = 100_000
#: Memory of one embedded database; more goes to the shared folder where that is a file system's, else the task fails.
MEMORY = "1GB"
#: A feed of fewer changes than this times the number of buckets is looked through for the buckets that it touches.
SPARSE = 8


def _upserts(keys: Sequence[str], states: int | None, spill: str = ""):
    """A function for mapInArrow: changes in, the latest change per key out. states: bound of the table, None for a whole bucket. spill: folder beyond MEMORY."""
    names = ", ".join(f'"{k}"' for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False, "memory_limit": MEMORY, "temp_directory": spill})
        made = False

        def put(rows: pa.Table) -> None:
            nonlocal made
            con.register("incoming", rows)
            if not made:
                con.execute("CREATE OR REPLACE TABLE state AS SELECT * FROM incoming LIMIT 0")
                con.execute(f"ALTER TABLE state ADD PRIMARY KEY ({names})")
                made = True
            # one row per key and statement: an upsert can't touch a row twice
            con.execute(
                f"""INSERT INTO state
                SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY _seq DESC, _op DESC, _payload DESC NULLS LAST) = 1
                ON CONFLICT ({names}) DO UPDATE SET _seq = excluded._seq, _op = excluded._op, _payload = excluded._payload
                WHERE (excluded._seq, excluded._op, coalesce(excluded._payload, '')) > (state._seq, state._op, coalesce(state._payload, ''))"""
            ).fetchall()
            con.unregister("incoming")

        def export() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if made:
                yield from con.sql("SELECT * FROM state").to_arrow_reader(ROWS)
                con.execute("DROP TABLE state")
                made = False

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                put(pa.Table.from_batches(held))
                held, n = [], 0
                if states and con.execute("SELECT count(*) FROM state").fetchall()[0][0] >= states:
                    yield from export()
        if n:
            put(pa.Table.from_batches(held))
        yield from export()
        con.close()

    return run


def apply_changes(feed: DataFrame, keys: Sequence[str], sequence: str, operation: str, payload: F.Column | None = None, buckets: int | None = None, publish_to: str | None = None) -> DataFrame:
    """The rows that exist after the feed: keys, `_seq` (sequence of the change that made the row) and `_payload` (string).

    payload: what a row holds, as a string expression (for instance the row image as JSON). publish_to: root of the BucketedTable to which the feed is applied, on top of the feeds
    before; without one, a table of the feed alone. buckets: of a new table at least, by default the session's number of shuffle partitions. Raises Conflict where
    someone else published to the table meanwhile; applying the feed again, also a part of it, changes nothing that was right.
    """
    spark = feed.sparkSession
    ship(spark)
    table = BucketedTable(spark, publish_to or scratch_path(spark, "applied"), keys)
    number = table.head()
    content = table.content(number)
    changes = feed.where(F.col(operation).isin(INSERT, UPDATE, DELETE) & F.col(sequence).isNotNull() & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    changes = changes.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col(sequence).cast("long").alias("_seq"),
        F.col(operation).cast("int").alias("_op"),
        F.when(F.col(operation) != DELETE, payload if payload is not None else F.lit(None).cast("string")).alias("_payload"),
    )
    size = changes.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("keys")).first()
    n = table.buckets_for(content, size["keys"], buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = table.bucket(n).alias("_bucket")
    touched = None
    if content.get("buckets") == n and size["n"] < SPARSE * n:
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most n
    changes = changes.select("*", bucket)
    shape = changes.schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in shape.fields])
    rows = changes.mapInArrow(_upserts(keys, STATES), schema)
    state = table.read_buckets(content, touched)
    if state is not None:
        rows = rows.unionByName(state.select(*[c for c in shape.names if c != "_bucket"], bucket))
    folder = shared_dir(spark)
    spill = folder.removeprefix("file://") + "/duckdb" if folder.startswith("file:") else ""
    whole = rows.repartitionById(n, F.col("_bucket")).mapInArrow(_upserts(keys, None, spill), schema)
    parts, kept = table.stage_buckets(whole)
    table.publish(table.merged(content, n, touched, parts, kept), number)
    return applied(spark, table.root, keys) if parts or content.get("parts") else spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name not in ("_op", "_bucket")]))


def applied(spark, root: str, keys: Sequence[str]) -> DataFrame | None:
    """The rows that exist in a table to which feeds were applied; None before the first."""
    rows = BucketedTable(spark, root, list(keys)).read()
    return None if rows is None else rows.where(F.col("_op") != DELETE).drop("_op")


def rejected(feed: DataFrame, keys: Sequence[str], sequence: str, operation: str) -> DataFrame:
    """Rows of the feed that name no change, by reason."""
    reason = F.when(F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys)), "no key").when(F.col(sequence).isNull(), "no sequence").when(~F.coalesce(F.col(operation).isin(INSERT, UPDATE, DELETE), F.lit(False)), "no operation")
    return feed.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where(F.col("reason").isNotNull())
