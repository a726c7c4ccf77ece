import datetime as dt
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from marlgraph.functions import bloom
from marlgraph.functions.skew import hot_keys, join_skewed
from marlgraph.operators import heavy_keys, incremental, orphans, wide
from marlgraph.runtime import Conflict, scratch_path
from marlgraph.streaming import dedupe

EDGES = "request_id long, tenant_id string, source_id long, target_id long, op string, requested_at timestamp_ntz, n string"
RUNS = "tenant_id string, node_id long, run_no long, out_edges array<long>, in_edges array<long>"
VERTICES = "write_id long, tenant_id string, node_id long, op string, written_at timestamp_ntz, kind string"
T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def test_heavy_keys(spark):
    hub = [(i, None, 1, i % 5000, "PUT", at(0), "") for i in range(20_000)]
    rows = hub + [(i, "t", i, 7, "DELETE", None, "") for i in range(300)] + [(1, "", None, 5, None, None, ""), (2, "", 2, None, None, None, "")]
    e = spark.createDataFrame(rows, EDGES)
    a = spark.createDataFrame([(None, 1, 0, [1, 2, 9000], None), ("t", 3, 0, [], []), ("t", 3, 1, None, []), ("t", None, 1, [4], []), ("t", 500, 1, [7] * 400 + [None], [])], RUNS)
    assert rows_of(heavy_keys.heavy_sources(e, a).select("tenant_id", "source_id", "n")) == [("default", 1, 20_003), ("t", 500, 401)]
    d = {(r.tenant_id, r.source_id): (r.degree, r.neighbours) for r in heavy_keys.degrees(e, a).collect()}
    assert d["default", 1] == (20_003, 5001) and d["default", 2] == (1, 0) and d["t", 500] == (401, 1) and ("t", None) not in d
    seg = heavy_keys.neighbour_segments(heavy_keys.edge_pairs(e, a), 100)
    hub_list = [x for r in seg.where("tenant_id = 'default' AND source_id = 1").orderBy("segment").collect() for x in r.neighbours]
    assert hub_list == [*range(5000), 9000] and seg.agg(F.max(F.size("neighbours"))).first()[0] == 100
    assert heavy_keys.heavy_sources(e.limit(0), a.limit(0)).count() == 0 and heavy_keys.neighbour_segments(heavy_keys.edge_pairs(e.limit(0), a.limit(0))).count() == 0


def test_covered_is_the_range_join(spark):
    rnd = random.Random(3)
    for bound in (50, 5000, 3_000_000):
        messages = [(rnd.choice("AB"), rnd.randrange(-20, bound), at(rnd.randrange(100))) for _ in range(300)]
        runs = []
        for _ in range(60):
            f = rnd.randrange(-30, bound)
            runs.append((rnd.choice("AB"), f, f + rnd.choice([0, 1, 5, 700, 2000, bound]), at(rnd.choice([5, 50, 90, None]))))
        m = spark.createDataFrame(messages, "g string, lsn long, arrived timestamp_ntz").distinct()
        r = spark.createDataFrame(runs, "g string, from_seq long, to_seq long, read_until timestamp_ntz")
        want = sorted({x for x in messages if any(g == x[0] and f < x[1] <= t and u is not None and x[2] <= u for g, f, t, u in runs)}, key=repr)
        assert rows_of(incremental.covered(m, r, "g", "lsn", "arrived").select("g", "lsn", "arrived")) == want
    assert incremental.covered(m, r.limit(0), "g", "lsn", "arrived").count() == 0 and incremental.covered(m.limit(0), r, "g", "lsn", "arrived").count() == 0


def test_incremental_runs(spark):
    load = incremental.IncrementalLoad(spark, scratch_path(spark, "load"), ["k"])
    make = lambda rows: spark.createDataFrame(rows, "k string, v string, content_hash string")
    picked = lambda df: rows_of(df.select("k", "change").distinct())
    one = make([("a", "1", ""), ("a", "1", "again"), ("b", None, ""), (None, "x", "")])
    assert rows_of(load.changes(load.hashed(one, ["v"])).select("k", "change")) == [("a", "new"), ("b", "new")]
    assert picked(load.run(one, ["v"])) == [("a", "new"), ("b", "new")]
    two = make([("a", "1", ""), ("b", "", ""), ("c", "x" * 100_000, "")])
    assert picked(load.run(two, ["v"])) == [("b", "changed"), ("c", "new")]
    assert load.run(two, ["v"]).count() == 0 and load.changes(load.hashed(one, ["v"])).where("k = 'a'").count() == 0
    load.run(make([("d", "1", ""), ("d", "2", "")]), ["v"])
    assert load.run(make([("d", "2", ""), ("d", "1", ""), ("d", "1", "")]), ["v"]).count() == 0 and picked(load.run(make([("d", "1", "")]), ["v"])) == [("d", "changed")]
    assert [o.count() for o in load.outputs()] == [3, 2, 0, 2, 0, 1] and load.run(one.limit(0), ["v"]).count() == 0


def test_a_failed_run_leaves_no_trace(spark):
    """Failures before the commit and after it: output and state go together."""
    root = scratch_path(spark, "load")
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    load = incremental.IncrementalLoad(spark, root, ["k"])
    load.run(make([("a", "1")]), ["v"])
    before = load.table.content()
    with pytest.raises(Exception, match="no more"):
        load.run(make([("a", "1"), ("b", "1")]), ["v"], lambda df: df.withColumn("x", F.raise_error(F.lit("no more")).cast("string")))
    assert load.table.content() == before
    published = load.table.publish
    load.table.publish = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):  # everything is written, only the commit is missing
        load.run(make([("a", "1"), ("b", "1")]), ["v"])
    assert load.table.content() == before
    load.table.publish = lambda *a: published(*a) / 0
    with pytest.raises(ZeroDivisionError):  # the process died right after the commit
        load.run(make([("a", "1"), ("b", "1")]), ["v"])
    again = incremental.IncrementalLoad(spark, root, ["k"])
    assert again.run(make([("a", "1"), ("b", "1")]), ["v"]).count() == 0
    assert [rows_of(o.select("k")) for o in again.outputs()] == [[("a",)], [("b",)], []]


def test_a_source_that_grows_during_a_run_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/source"
    add = lambda rows: spark.createDataFrame(rows, "k string, v string").write.mode("append").parquet(path)
    read = lambda: spark.read.parquet(path)
    add([("a", "1")])
    load = incremental.IncrementalLoad(spark, scratch_path(spark, "load"), ["k"])

    def slow(df):
        add([("b", "1"), ("a", "2")])
        return df

    assert rows_of(load.run(read(), ["v"], slow).select("k", "v")) == [("a", "1")]
    assert rows_of(load.run(read(), ["v"]).select("k", "v", "change")) == [("a", "1", "changed"), ("a", "2", "changed"), ("b", "1", "new")]
    assert load.run(read(), ["v"]).count() == 0


def test_of_two_runs_at_once_one_fails(spark):
    root = scratch_path(spark, "load")
    rows = spark.createDataFrame([("a", "1")], "k string, v string")
    one, two = (incremental.IncrementalLoad(spark, root, ["k"]) for _ in range(2))
    with pytest.raises(Conflict):
        one.run(rows, ["v"], lambda df: two.run(rows, ["v"]))
    assert len(one.outputs()) == 1


def test_orphans_match_brute_force(spark):
    rnd = random.Random(5)
    edges = [(i, rnd.choice([None, "", "default", "t"]), rnd.choice([None, 1, 2, 3, 4, 50]), rnd.choice([None, 1, 2, 3, 4, 60]), rnd.choice([None, "PUT", "DELETE", " put "]), at(rnd.choice([None, 0, 1, 1.5, 2, 30, 31, 100])), "x") for i in range(300)]
    edges += edges[:50]
    writes = [(i, rnd.choice([None, "default", "t"]), rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, "PUT", "DELETE", "DELETE"]), at(rnd.choice([0, 1, 1.5, 2, 29, 30, 31])), "x") for i in range(25)]
    writes += writes[:5]
    want = set()
    for i, tenant, s, d, op, when, _ in edges:
        if (op or "PUT").strip().upper() != "PUT":
            continue
        for end, node in (("source", s), ("target", d)):
            if node is None:
                continue
            own = [w for w in writes if (w[1] or "default") == (tenant or "default") and w[2] == node]
            if not own:
                want.add((i, end, "missing"))
            elif when is not None:
                if min(w[4] for w in own) > when:
                    want.add((i, end, "late"))
                else:
                    last = max((w for w in own if w[4] <= when), key=lambda w: (w[4], w[0]))
                    if last[3] == "DELETE":
                        want.add((i, end, "deleted"))
    e, v = spark.createDataFrame(edges, EDGES), spark.createDataFrame(writes, VERTICES)
    found = orphans.orphans(e, v)
    assert set(map(tuple, found.select("request_id", "endpoint", "kind").collect())) == want and {k for _, _, k in want} == {"missing", "late", "deleted"}
    tight = orphans.orphans(e, v, bits=64)  # nearly every test of the filter is a false positive
    assert set(map(tuple, tight.select("request_id", "endpoint", "kind").collect())) == want
    assert {r.kind for r in orphans.orphans(e, v.limit(0)).collect()} == {"missing"} and orphans.orphans(e.limit(0), v).count() == 0
    assert orphans.orphan_report(found).agg(F.sum("orphans")).first()[0] == found.count()


def test_filter_keeps_its_share_with_tiny_sections(spark, monkeypatch):
    """Sections of 2,048 bits for 2,000 parents: nearly all definite orphans are still proven at the scan, and without any filter the rows are the same."""
    assert bloom.supported(spark)  # this Spark's own expressions are used; elsewhere there is no filter
    parents = spark.range(2000).select(F.lit("default").alias("tenant_id"), F.col("id").alias("node_id"))
    e = spark.range(4000).select(F.col("id").alias("request_id"), F.lit(None).cast("string").alias("tenant_id"), F.col("id").alias("source_id"), F.lit(None).cast("long").alias("target_id"), F.lit("PUT").alias("op"), F.lit(T0).cast("timestamp_ntz").alias("requested_at"))
    tested = orphans.tested_references(e, parents, bits=2048)
    proven = tested.where("NOT maybe")
    assert proven.where("node_id < 2000").count() == 0 and proven.count() >= 0.9 * 2000
    made = bloom.bloom_of(parents.select(F.xxhash64("tenant_id", "node_id").alias("h")), "h", 2000, 2048)
    assert len(made.sections) == 10 and bloom.bloom_of(parents.select(F.xxhash64("tenant_id", "node_id").alias("h")), "h", 2000, 64).sections is None
    v = parents.select(F.col("node_id").alias("write_id"), "tenant_id", "node_id", F.lit("PUT").alias("op"), F.lit(T0).cast("timestamp_ntz").alias("written_at"))
    want = rows_of(orphans.orphans(e, v).select("request_id", "kind"))
    monkeypatch.setattr(bloom, "supported", lambda s: False)
    assert rows_of(orphans.orphans(e, v).select("request_id", "kind")) == want and len(want) == 2000


def test_one_moment_of_one_vertex_is_split(spark):
    """Twenty thousand writes and references of one vertex within one hour, half of them at one moment."""
    writes = [(i, "t", 1, "DELETE" if i % 2 else "PUT", at(0) if i < 5000 else at(0) + dt.timedelta(milliseconds=i), "") for i in range(10_000)]
    edges = [(i, "t", 1, None, "PUT", at(0) if i < 5000 else at(0) + dt.timedelta(milliseconds=i), "") for i in range(10_000)]
    got = {r.request_id for r in orphans.orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(writes, VERTICES)).where("kind = 'deleted'").collect()}
    assert got == {*range(5000), *(i for i in range(5000, 10_000) if i % 2)}


def test_skewed_join_keeps_every_row(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "hub"), (4500, "x")], "k long, w string")
    assert hot_keys(left, ["k"]) == [(1,)]
    for how in ("left", "inner"):
        assert rows_of(join_skewed(left, right, ["k"], how)) == rows_of(left.join(right, "k", how))


CATALOG = [("menge", "long", ["order qty"]), ("netpr", "double", None), ("lvorm", "boolean", []), ("erdat", "date", []), ("maktx", "string", ["Material-Text", None])]


def test_wide_formats(spark):
    cases = {
        "menge": {" 12 ": 12, "-5": -5, "5-": -5, "+007": 7, "1,234": 1234, "12,34": None, "1.0": None, "#": None, "9223372036854775808": None, "--1": None, "": None, "1 2": None, "-5-": None},
        "netpr": {"1,234.50": 1234.5, "1.5-": -1.5, ".5": 0.5, "2.": 2.0, "00.10": 0.1, "1e5": None, "NaN": None, "1,23.4": None, "abc": None},
        "lvorm": {"X": True, "yes": True, "N": False, "0": False, "TRUE": True, "": None, "2": None, " no ": False},
        "erdat": {"2024-02-29": dt.date(2024, 2, 29), "2023-02-29": None, "20240131": dt.date(2024, 1, 31), "31.12.2023": dt.date(2023, 12, 31), "00000000": None, "2024-1-1": None},
        "maktx": {"x": "x", "   ": None, "\t": None, "a\n": "a\n", "y" * 50_000: "y" * 50_000},
    }
    rows, want, n = [], {}, 0
    for attr, values in cases.items():
        for text, value in values.items():
            n += 1
            rows.append(("t", n, attr.upper(), text, 1, None, "clash"))
            want[n] = (attr, text, value)
    df = spark.createDataFrame(rows, "tenant_id string, node_id long, attr_name string, attr_value string, write_seq long, written_at timestamp_ntz, failed string")
    catalog = spark.createDataFrame(CATALOG, "attr_name string, data_type string, alt_names array<string>")
    got = {r.node_id: r for r in wide.wide(df, catalog).collect()}
    for n, (attr, text, value) in want.items():
        assert got[n][attr] == value, (attr, text)
        assert got[n].failed == ({attr: text} if value is None and text.strip() else {}), (attr, text)
    filled = {(r.node_id, r.attr_name) for r in wide.filled_cells(wide.wide(df, catalog)).collect()}
    assert filled == {(n, a) for n, (a, _, v) in want.items() if v is not None}


def test_wide_resolution_and_ties(spark):
    rows = [
        (None, 1, "Order_Qty", "1", 1), ("", 1, "MENGE", "2", 3), ("default", 1, "men-ge", None, 2), (None, 1, "unknown", "9", 9), (None, None, "menge", "1", 1),
        (None, 2, "material text", "a", 5), (None, 2, "maktx", "b", 5), (None, 2, "maktx", "b", 5), (None, 2, None, "b", 5), (None, 3, "menge", "", 2), (None, 3, "menge", "7", 1), (None, 4, "menge", "4", None),
    ]
    df = spark.createDataFrame(rows, "tenant_id string, node_id long, attr_name string, attr_value string, write_seq long")
    catalog = spark.createDataFrame(CATALOG, "attr_name string, data_type string, alt_names array<string>")
    got = {r.node_id: (r.menge, r.maktx) for r in wide.wide(df, catalog).collect()}
    assert got == {1: (2, None), 2: (None, "b"), 3: (None, None), 4: (4, None)}
    assert wide.wide(df.limit(0), catalog).count() == 0 and wide.filled_cells(wide.wide(df, catalog.limit(0))).count() == 0


FEED = "src_table string, primary_key string, lsn long, ingested_at timestamp_ntz, copies long"


def _stream(spark, root):
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_stream_keeps_one_copy(spark, tmp_path):
    """Batches far apart in time, so that the state forgets and the lookup has to find; then a restart that adds a batch."""
    root, rnd = f"file://{tmp_path}", random.Random(2)
    days = [0, 1, 9, 20, 40]
    batches = [[("A", str(rnd.randrange(30)), rnd.randrange(3), at(24 * d + rnd.randrange(5)), 5) for _ in range(60)] + [("A", "hot", 1, at(24 * d), 5)] * 20 + [("A", None, 1, at(0), 5), ("A", "late", 7, None, 5)] for d in days]
    for i, rows in enumerate(batches[:4]):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{root}/in")
        dedupe.deduplicate(_stream(spark, root), ["src_table", "primary_key", "lsn"], "ingested_at", f"{root}/out", "2 days", buckets=5).awaitTermination()
    spark.createDataFrame(batches[4], FEED).coalesce(1).write.mode("append").parquet(f"{root}/in")
    dedupe.deduplicate(_stream(spark, root), ["src_table", "primary_key", "lsn"], "ingested_at", f"{root}/out", "2 days", buckets=5).awaitTermination()
    everything = [r[:3] for b in batches for r in b if r[1] is not None]
    key = ["src_table", "primary_key", "lsn"]
    kept = rows_of(dedupe.kept(spark, f"{root}/out").select(*key))
    assert kept == sorted(set(everything), key=repr)
    assert rows_of(dedupe.repeated(spark, f"{root}/out", key)) == sorted({(*k, everything.count(k) - 1) for k in everything if everything.count(k) > 1}, key=repr)


def test_batches_without_late_copies_read_no_earlier_output(spark, tmp_path, monkeypatch):
    """Twenty batches, days apart: only the one with a copy of something forgotten looks back, and only at that day."""
    root, key, looked = f"file://{tmp_path}", ["src_table", "primary_key", "lsn"], []
    whole = dedupe._batches
    monkeypatch.setattr(dedupe, "_batches", lambda s, r, before=None: looked.append(before) or whole(s, r, before))
    for k in range(20):
        rows = [("A", f"{k}-{i}", 1, at(48 * k), 1) for i in range(50)] + ([("A", "3-7", 1, at(48 * k), 1)] if k == 15 else [])
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{root}/in")
    dedupe.deduplicate(_stream(spark, root), key, "ingested_at", f"{root}/out", "1 day", buckets=4).awaitTermination()
    assert looked == [15] or (len(looked) == 1 and looked[0] is not None)
    assert rows_of(dedupe.repeated(spark, f"{root}/out", key)) == [("A", "3-7", 1, 1)] and dedupe.kept(spark, f"{root}/out").count() == 1000


def test_arrays_of_identifiers_merge():
    import numpy as np

    make = lambda pairs: np.array([(a, b, 0, 0) for a, b in pairs], dtype=dedupe._ENTRY)
    both, fresh = dedupe._merge(make([(1, 5), (2, 1), (2, 9)]), make([(1, 5), (2, 0), (2, 9), (7, 7)]))
    assert both[["a", "b"]].tolist() == [(1, 5), (1, 5), (2, 0), (2, 1), (2, 9), (2, 9), (7, 7)] and fresh.tolist() == [False, True, True, False, False, True, True]


def test_stream_replay_overwrites_a_batch(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([("A", "1", 1, at(0), 1), ("A", "1", 1, at(1), 1)], FEED).write.parquet(f"{root}/in")
    key = ["src_table", "primary_key", "lsn"]
    dedupe.deduplicate(_stream(spark, root), key, "ingested_at", f"{root}/out").awaitTermination()
    # the crash: the batch's output exists, its commit is gone
    for p in (tmp_path / "out/checkpoint/commits").iterdir():
        p.unlink()
    dedupe.deduplicate(_stream(spark, root), key, "ingested_at", f"{root}/out").awaitTermination()
    assert rows_of(dedupe.kept(spark, f"{root}/out").select(*key)) == [("A", "1", 1)] and dedupe.repeated(spark, f"{root}/out", key).count() == 1
    assert dedupe.kept(spark, f"{root}/nothing") is None
