import pyarrow as pa
import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgraph.functions.canonical import canonical_key
from marlgraph.operators import change_feed
from marlgraph.runtime import BucketedTable, Conflict, VersionedTable, scratch_path

SCHEMA = "src_table string, primary_key string, lsn long, operation int, v string, _seq string"


def expected(rows):
    best = {}
    for t, k, lsn, op, v, _ in rows:
        if None in (t, k, lsn) or op not in (1, 2, 3):
            continue
        key = (lsn, op, "" if op == 3 or v is None else v)
        if (t, k) not in best or key > best[t, k][0]:
            best[t, k] = (key, None if op == 3 else v)
    return sorted(((t, k, key[0], v) for (t, k), (key, v) in best.items() if key[1] != 3), key=repr)


def apply(df):
    return change_feed.apply_changes(df, ["src_table", "primary_key"], "lsn", "operation", F.col("v"), buckets=3)


one = st.tuples(st.sampled_from(["A", "B", None]), st.sampled_from(["1", "2", "3", None]), st.sampled_from([1, 2, 3, 4, None]), st.sampled_from([1, 2, 3, 0, None]), st.sampled_from(["x", "y", "", None, "z" * 2000]), st.just("clash"))


@given(st.lists(one, max_size=40), st.randoms())
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_order_and_repeats(spark, rows, rnd):
    rows = rows + rows[: len(rows) // 2]
    rnd.shuffle(rows)
    assert rows_of(apply(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_empty_and_rejected(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert apply(empty).count() == 0
    rows = spark.createDataFrame([("A", None, 1, 1, "", ""), ("A", "1", None, 1, "", ""), ("A", "1", 1, 0, "", ""), ("A", "1", 1, None, "", ""), ("A", "1", 1, 1, "", "")], SCHEMA)
    assert rows_of(change_feed.rejected(rows, ["src_table", "primary_key"], "lsn", "operation")) == [("no key", 1), ("no operation", 2), ("no sequence", 1)]


def test_bounded_tables_pass_states_on():
    n = 260_000
    rows = pa.table({"k": [str(i % 40_000) for i in range(n)], "_seq": list(range(n)), "_op": pa.array([1] * n, pa.int32()), "_payload": pa.array([None] * n, pa.string())})
    partial = pa.Table.from_batches(list(change_feed._upserts(["k"], 10_000)(iter(rows.to_batches(10_000)))))
    assert 40_000 < partial.num_rows <= 120_000
    whole = pa.Table.from_batches(list(change_feed._upserts(["k"], None)(iter(partial.to_batches()))))
    assert whole.num_rows == 40_000 and min(whole["_seq"].to_pylist()) == n - 40_000


def test_publishing_is_all_or_nothing(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"))
    assert table.read() is None
    table.replace(spark.range(3))
    staged = table.stage(spark.range(9))
    assert table.read().count() == 3  # written, not published
    table.publish(staged)
    assert table.read().count() == 9 and table.prune() == 1 and table.read().count() == 9


def test_second_of_two_writers_gets_a_conflict(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"))
    before = table.head()
    table.publish(table.stage(spark.range(3)), before)
    late = table.stage(spark.range(4))
    with pytest.raises(Conflict):
        table.publish(late, before)
    assert table.read().count() == 3 and table.publish(late) == 2 and table.read().count() == 4


def upsert(df, root):
    return change_feed.apply_changes(df, ["src_table", "primary_key"], "lsn", "operation", F.col("v"), buckets=3, publish_to=root)


@given(st.lists(one, min_size=6, max_size=40), st.integers(2, 3))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_feeds_in_any_split_equal_one(spark, rows, n):
    root = scratch_path(spark, "feeds")
    for k in range(n):
        got = upsert(spark.createDataFrame(rows[k::n], SCHEMA), root)
    assert rows_of(got) == expected(rows)


def test_tombstones_outlive_a_feed(spark):
    root = scratch_path(spark, "feeds")
    upsert(spark.createDataFrame([("T", "a", 1, 1, "", ""), ("T", "b", 5, 3, "", "")], SCHEMA), root)
    got = upsert(spark.createDataFrame([("T", "b", 4, 1, "", ""), ("T", "c", 1, 1, "", "")], SCHEMA), root)
    assert [r[1] for r in rows_of(got)] == ["a", "c"]
    assert rows_of(upsert(spark.createDataFrame([], SCHEMA), root)) == rows_of(got) == rows_of(change_feed.applied(spark, root, ["src_table", "primary_key"]))


def test_untouched_buckets_keep_their_files_and_their_number_grows(spark, monkeypatch):
    monkeypatch.setattr(BucketedTable, "ROWS", 20)
    root, keys = scratch_path(spark, "feeds"), ["src_table", "primary_key"]
    make = lambda ids, lsn: spark.createDataFrame([("T", str(i), lsn, 2, str(i), "") for i in ids], SCHEMA)
    upsert(make(range(50), 1), root)
    table = BucketedTable(spark, root, keys)
    first = table.content()
    upsert(make([7], 2), root)
    second = table.content()
    changed = {b for b in second["parts"] if second["parts"][b] != first["parts"][b]}
    assert len(changed) == 1 and second["buckets"] == first["buckets"] == 4
    upsert(make(range(50, 400), 3), root)
    third = table.content()
    assert third["buckets"] >= 16 and sum(n for _, n in third["parts"].values()) == 400 and max(n for _, n in third["parts"].values()) < 80
    assert table.prune() >= 2 and sorted(int(r.primary_key) for r in change_feed.applied(spark, root, keys).collect()) == list(range(400))


def test_canonical_keys(spark):
    rows = spark.createDataFrame([(" 0000000500|000010 ",), ("mat-1",), ("000",), ("0|00",), (None,), ("",)], "k string")
    assert [r[0] for r in rows.select(canonical_key("k")).collect()] == ["500|10", "MAT-1", "0", "0|0", None, ""]
