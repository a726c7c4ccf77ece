"""Exactly one copy of every message that was delivered at least once, over a stream.

A keyed state store holds the identifiers seen, as 128-bit hashes in one sorted array per small bucket. An identifier expires when the event-time watermark passes it; what stays of it is
a 32-bit fingerprint under the day of its kept copy. State, offsets and output advance together: state and offsets by the checkpoint, the output of a
micro-batch as one folder named by the batch, which a replay overwrites with the same rows. A copy that arrives after its identifier expired, however late, meets its
fingerprint and is looked up exactly in the output of earlier batches, of which only the days and shelves that fingerprints name are read. A micro-batch without such a
match reads no earlier output; what grows with the past are four bytes of state for each identifier, so buckets should be many where a stream lasts long.

Copies of one identifier within an input partition are combined before the shuffle, so a message delivered millions of times is a few rows of its bucket.

Cases: rows with a null key column can't be identified and are left out; a null event time counts as the earliest; of copies at the same time
the first in arrival order within its partition is kept; an empty stream gives empty output; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlgraph.runtime import ship

#: Event time that an identifier stays in the state.
DELAY = "3 days"
#: Buckets of a new stream at least; shelves into which a day's output is divided by bucket.
BUCKETS, SHELVES = 1_024, 4
DAY = 86_400_000_000
_ENTRY = [("a", "<i8"), ("b", "<i8"), ("t", "<i8"), ("day", "<i4")]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest copy of each identifier of a batch, with the number of copies."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b", "_t"))
        order = np.lexsort((t, b, a))
        first = np.flatnonzero(np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        n = np.diff(np.r_[first, len(order)])
        kept = batch.take(pa.array(order[first]))
        yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in kept.schema.names if c != "_n"], pa.array(n, pa.int64())], names=[*[c for c in kept.schema.names if c != "_n"], "_n"])


def _merge(seen, new):
    """Both arrays sorted by (a, b), earlier entries before new ones of the same identifier, and which of them are new. The arrays are sorted each, which the stable sort makes use of."""
    import numpy as np

    both = np.concatenate([seen, new])
    fresh = np.r_[np.zeros(len(seen), bool), np.ones(len(new), bool)]
    order = np.argsort(both["a"], kind="stable")
    a, b = both["a"][order], both["b"][order]
    if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():  # two identifiers share 64 bits
        order = np.lexsort((fresh, both["b"], both["a"]))
    return both[order], fresh[order]


def _prints(entries):
    import numpy as np

    return (entries["b"].astype(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _recognise(columns: Sequence[str]):
    def run(key, frames, state: GroupState):
        import pickle

        import numpy as np
        import pandas as pd

        seen, past = (np.frombuffer(state.get[0], dtype=_ENTRY), pickle.loads(state.get[1])) if state.exists else (np.empty(0, dtype=_ENTRY), {})
        rows = pd.concat(list(frames), ignore_index=True)
        rows = rows.iloc[np.lexsort((rows["_t"].to_numpy(), rows["_b"].to_numpy(), rows["_a"].to_numpy()))]
        a, b, t = rows["_a"].to_numpy(), rows["_b"].to_numpy(), rows["_t"].to_numpy()
        first = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])
        n = np.add.reduceat(rows["_n"].to_numpy(), first)
        rows = rows.iloc[first].reset_index(drop=True)
        new = np.empty(len(rows), dtype=_ENTRY)
        new["a"], new["b"], new["t"], new["day"] = a[first], b[first], np.maximum.reduceat(t, first), t[first] // DAY
        both, fresh = _merge(seen, new)
        again = np.r_[False, (both["a"][1:] == both["a"][:-1]) & (both["b"][1:] == both["b"][:-1])]
        known = again[fresh]  # rows are in the same order as `new`
        # days under which an unknown identifier may have been kept and forgotten
        days: list[list[int]] = [[] for _ in range(len(rows))]
        if past:
            own = _prints(new)
            for day, prints in past.items():
                held = np.frombuffer(prints, np.uint32)
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                for i in np.flatnonzero((held[at] == own) & ~known):
                    days[i].append(day)
        start = np.flatnonzero(~again)
        held = both[start].copy()
        held["t"] = np.maximum.reduceat(both["t"], start)
        horizon = state.getCurrentWatermarkMs() * 1000
        gone = held[held["t"] < horizon]
        held = held[held["t"] >= horizon]
        for day in np.unique(gone["day"]):
            past[int(day)] = np.union1d(np.frombuffer(past.get(int(day), b""), np.uint32), _prints(gone[gone["day"] == day])).astype(np.uint32).tobytes()
        state.update((held.tobytes(), pickle.dumps(past)))
        out = rows[list(columns)].copy()
        out["_t"], out["copies"], out["known"], out["days"], out["_bucket"] = rows["_t"], n, known, days, int(key[0])
        yield out

    return run


def recognised(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = DELAY, carry: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Per micro-batch and identifier: its first copy (keys, carried columns, `_t`), `copies` in the batch, whether the state had it (`known`), and the `days` under which it may have been forgotten.

    buckets: how many arrays hold the identifiers; it must stay the same for a checkpoint, as `deduplicate` sees to.
    """
    spark = stream.sparkSession
    ship(spark)
    buckets = buckets or max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [*keys, *carry]
    rows = stream.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    rows = rows.select(*columns, F.coalesce(F.unix_micros(F.col(event_time).cast("timestamp")), F.lit(0)).alias("_t"), F.xxhash64(*keys).alias("_a"), F.xxhash64(F.lit("second"), *keys).alias("_b"), F.lit(1).cast("long").alias("_n"))
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    rows = rows.mapInArrow(_combine, shape)
    rows = rows.withColumn("_at", F.timestamp_micros("_t")).withWatermark("_at", delay).withColumn("_bucket", F.pmod("_b", F.lit(buckets)))
    out = T.StructType([*[f for f in shape.fields if f.name in columns], T.StructField("_t", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("known", T.BooleanType()), T.StructField("days", T.ArrayType(T.IntegerType())), T.StructField("_bucket", T.IntegerType())])
    held = T.StructType([T.StructField("seen", T.BinaryType()), T.StructField("past", T.BinaryType())])
    return rows.groupBy("_bucket").applyInPandasWithState(_recognise(columns), out, held, "append", GroupStateTimeout.NoTimeout)


def deduplicate(stream: DataFrame, keys: Sequence[str], event_time: str, root: str, delay: str = DELAY, carry: Sequence[str] = (), buckets: int | None = None, trigger: dict | None = None):
    """Starts the streaming query; `root` gets the checkpoint and the output. See `kept` and `repeated` for reading it."""
    spark = stream.sparkSession
    buckets = _buckets(spark, root, buckets)

    def write(batch: DataFrame, number: int) -> None:
        now = f"{root}/batches/batch={number}"
        staged = f"{root}/staged/{number}"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged).withColumns({"day": F.floor(F.col("_t") / DAY).cast("int"), "shelf": F.pmod("_bucket", F.lit(SHELVES))})
        doubtful = F.size("days") > 0
        places = rows.where(doubtful).select("shelf", F.explode("days").alias("day")).distinct().collect()  # at most SHELVES for each day
        earlier = _batches(spark, root, before=number) if places else None
        if earlier is not None:
            named = F.struct("day", "shelf").isin([F.struct(F.lit(p["day"]).alias("day"), F.lit(p["shelf"]).alias("shelf")) for p in places])
            pruned = earlier.where(F.col("day").isin(sorted({p["day"] for p in places})) & F.col("shelf").isin(sorted({p["shelf"] for p in places})) & named & F.col("kept"))
            found = rows.where(doubtful).select(*keys).join(pruned.select(*keys), list(keys), "left_semi").withColumn("_old", F.lit(True))
            rows = rows.join(found, list(keys), "left").withColumn("known", F.col("known") | F.coalesce("_old", F.lit(False))).drop("_old")
        rows = rows.withColumns({"kept": ~F.col("known"), "dropped": F.col("copies") - F.when(F.col("known"), 0).otherwise(1)})
        rows = rows.drop("known", "days", "copies", "_bucket").hint("rebalance", F.col("day"), F.col("shelf"))
        rows.write.mode("overwrite").partitionBy("day", "shelf").parquet(now)

    return (
        recognised(stream, keys, event_time, delay, carry, buckets)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _buckets(spark, root: str, wanted: int | None) -> int:
    """The number of buckets with which the first run began; identifiers keep to their bucket over restarts, whatever the session's settings are."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/buckets")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        try:
            return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    number = wanted or max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = fs.create(path, False)
    out.write(bytearray(str(number), "utf-8"))
    out.close()
    return number


def _batches(spark, root: str, before: int | None = None) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbers = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    done = [n for n in numbers if (before is None or n < before) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches/batch={n}/_SUCCESS"))]
    done = [n for n in done if any("=" in s.getPath().getName() for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches/batch={n}")))]
    return spark.read.option("basePath", f"{root}/batches").parquet(*[f"{root}/batches/batch={n}" for n in sorted(done)]) if done else None


def kept(spark, root: str) -> DataFrame | None:
    """The one copy of each message."""
    rows = _batches(spark, root)
    return None if rows is None else rows.where("kept").drop("kept", "dropped", "batch", "day", "shelf")


def repeated(spark, root: str, keys: Sequence[str]) -> DataFrame | None:
    """Messages of which copies were dropped, that is, which came two or more times, with the number of copies `dropped`."""
    rows = _batches(spark, root)
    return None if rows is None else rows.where("dropped > 0").groupBy(*keys).agg(F.sum("dropped").alias("dropped"))
