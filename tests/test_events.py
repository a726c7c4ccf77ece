import datetime as dt
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from marlgraph.operators import store
from marlgraph.plans.catalog import EdgeMapping, load_catalog, parse_catalog, save_catalog
from marlgraph.runtime import Conflict
from marlgraph.sources import events
from marlgraph.streaming import ingest


def test_insert_events_and_values(spark):
    rows = spark.createDataFrame([(2, "b", 1.5, True, bytearray(b"x"), dt.date(2024, 1, 2)), (1, None, None, None, None, None), (1, "a", 0.0, False, None, None)], "k long, s string, d double, b boolean, y binary, t date")
    got = {r.lsn: r for r in events.insert_events(rows, "T", ["k", "s"]).collect()}
    assert sorted(got) == [1, 2, 3] and [got[i].primary_key for i in (1, 2, 3)] == ["1|", "1|a", "2|b"]
    image = got[3].after_image
    assert (image["s"].string_value, image["k"].int_value, image["d"].double_value, image["b"].bool_value, bytes(image["y"].bytes_value), image["t"].string_value) == ("b", 2, 1.5, True, b"x", "2024-01-02")
    assert all(v is None for v in got[1].after_image["s"]) and got[1].operation == 1
    assert events.insert_events(rows.limit(0), "T", ["k"]).count() == 0


def test_poison_messages_stop_nothing(spark):
    raw = spark.createDataFrame([('{"src_table":"A","primary_key":"1","lsn":5,"operation":1,"after_image":{"x":{"int_value":3}}}',), ("nonsense",), (None,), ("{}",)], "value string")
    got = events.from_json_lines(raw).select("src_table", "lsn", "corrupt", F.col("after_image")["x"]["int_value"].alias("x"))
    assert rows_of(got) == sorted([("A", 5, None, 3), (None, None, "nonsense", None), (None, None, None, None), (None, None, None, None)], key=repr)


def test_demo_edges(spark):
    e = spark.createDataFrame([("7", 1, 1), ("3|4", 2, 2), ("a|4", 3, 3), ("1|2|3", 1, 4), (None, 1, 5), ("", 1, 6)], "primary_key string, operation int, lsn long")
    assert rows_of(events.edges_of_keys(e).select("src", "dst", "op")) == sorted([(7, 8, "PUT"), (3, 4, "PUT"), (1, 2, "DELETE"), (1, 2, "PUT"), (1, 2, "PUT"), (1, 2, "PUT")], key=repr)


def test_graph_writes_by_the_catalog(spark):
    catalog = parse_catalog("NODE M FROM mara WITH id = matnr PROPERTIES (maktx) EDGE S FROM ekpo USING matnr -> lifnr PROPERTIES (menge)")
    value = lambda **k: {c: (None, v, None, None, None) if isinstance(v, int) else (v, None, None, None, None) for c, v in k.items()}
    shape = "src_table string, primary_key string, operation int, before_image map<string,struct<string_value string,int_value long,double_value double,bool_value boolean,bytes_value binary>>, after_image map<string,struct<string_value string,int_value long,double_value double,bool_value boolean,bytes_value binary>>, lsn long"
    rows = [("MARA", "1", 1, None, value(matnr=1, maktx="Steel"), 1), ("mara", "1", 2, None, value(matnr=1), 2), ("MARA", "2", 1, None, value(matnr="2"), 3), ("MARA", "2", 3, value(matnr=2), None, 4), ("EKPO", "1", 1, None, value(matnr=1, lifnr=9, menge=5), 1), ("EKPO", "x", 1, None, value(matnr="x", lifnr=9), 2), ("OTHER", "1", 1, None, None, 1), ("MARA", "3", 0, None, value(matnr=3), 9)]
    vertices, edges = events.graph_writes(spark.createDataFrame(rows, shape), catalog)
    assert rows_of(store.latest_vertices(vertices).select("node_id", "properties")) == [(1, {"label": "M"})]
    assert rows_of(store.latest_edges(edges).select("src", "dst", "properties")) == [(1, 9, {"label": "S", "menge": "5"})]


VALUE_MAP = "map<string,struct<string_value string,int_value long,double_value double,bool_value boolean,bytes_value binary>>"
CHANGE = f"src_table string, primary_key string, operation int, before_image {VALUE_MAP}, after_image {VALUE_MAP}, lsn long"


def image(**k):
    return {c: (None, v, None, None, None) for c, v in k.items()}


def test_a_moved_edge_and_a_changed_key_leave_nothing_behind(spark):
    catalog = parse_catalog("NODE M FROM mara WITH id = matnr NODE V FROM lfa1 WITH id = lifnr EDGE S FROM ekpo USING matnr -> lifnr")
    rows = [("EKPO", "1", 1, None, image(matnr=7, lifnr=8), 1), ("EKPO", "1", 2, image(matnr=7, lifnr=8), image(matnr=7, lifnr=9), 2), ("MARA", "7", 1, None, image(matnr=7), 1), ("MARA", "7", 2, image(matnr=7), image(matnr=8), 2), ("LFA1", "7", 1, None, image(lifnr=7), 1), ("EKPO", "2", 2, None, image(matnr=1, lifnr=1), 3)]
    vertices, edges = events.graph_writes(spark.createDataFrame(rows, CHANGE), catalog)
    assert rows_of(store.latest_edges(edges).select("src", "dst")) == [(448, 577), (64, 65)]
    assert rows_of(store.latest_vertices(vertices).select("node_id")) == [(449,), (512,)]


def test_ends_of_edges():
    c = parse_catalog("NODE C FROM customer WITH id = c_custkey NODE O FROM orders WITH id = o_orderkey NODE X FROM x WITH id = id NODE Y FROM y WITH id = id EDGE P FROM orders USING o_custkey -> o_orderkey EDGE Z FROM z USING id -> other")
    assert c.ends_of(c.edges["P"]) == ("C", "O") and c.ends_of(c.edges["Z"]) == (None, None) and c.codes()["X"] == 2 and c.width() == 64
    c.add(EdgeMapping("Q", "z", "id", "other", ends=("X", "Y")))
    assert c.ends_of(c.edges["Q"]) == ("X", "Y")


def test_a_poller_keeps_its_place(spark, tmp_path):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "lsn long, primary_key string")
    make = lambda: events.Poller(spark, f"file://{tmp_path}/place", 1)
    keys = lambda df: [r[0] for r in rows_of(df.select("primary_key"))]
    p = make()
    assert keys(p.take(log)) == ["a"] and keys(make().take(log)) == ["a"]  # not done, so handed out again
    p.done()
    q = make()
    assert q.after == 1 and keys(q.take(log)) == ["b", "c"]
    other = make()
    other.take(log), other.done()
    with pytest.raises(Conflict):
        q.done()
    last = make()
    assert keys(last.take(log)) == ["d"]
    last.done(), last.done()
    assert keys(make().take(log)) == [] and make().after == 3


def test_sample_events_and_the_kafka_reader(spark, tmp_path):
    stream = events.sample_events(spark, 50)
    assert stream.isStreaming and {"src_table", "primary_key", "operation", "after_image", "txid", "lsn"} <= set(stream.columns)
    query = stream.select("primary_key", "txid", "lsn").writeStream.format("memory").queryName("made").start()
    while not query.lastProgress or not spark.table("made").count():
        query.processAllAvailable()
    query.stop()
    rows = spark.table("made").orderBy("lsn").collect()
    assert [r.lsn for r in rows] == list(range(1, len(rows) + 1)) and rows[0].txid == "TX00000001"
    with pytest.raises(Exception, match="(?i)kafka"):  # without the connector the reader says what is missing
        events.kafka_events(spark, "localhost:1", "t")


def test_mapping_files(spark, tmp_path):
    c = parse_catalog("NODE A FROM a WITH id = k PROPERTIES (v) EDGE E FROM a USING k -> v")
    path = f"file://{tmp_path}/maps/one.dsl"
    for _ in range(2):
        save_catalog(spark, c, path)
    assert load_catalog(spark, path) == c and (tmp_path / "maps/one.dsl").read_text() == c.text() + "\n"


def test_replay_has_one_effect_each(spark, tmp_path):
    """A thousand events, half of them again after a restart."""
    root = f"file://{tmp_path}"
    schema = "src_table string, primary_key string, lsn long"
    rows = [("MARA", f"MAT-{i}", i) for i in range(1000)]
    for part in (rows[:500], rows[:500], rows[500:], [("MARA", "MAT-1", 5000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = ingest.drop_repeats(spark.readStream.schema(schema).parquet(f"{root}/in"))
        ingest.append_to_log(stream, f"{root}/log", f"{root}/ck").awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    assert log.count() == 1001 and log.distinct().count() == 1001  # the same key with another lsn passes


def test_dispatch(spark, tmp_path):
    root, seen = f"file://{tmp_path}", {}
    spark.createDataFrame([("a", 1), ("A", 2), ("b", 3), (None, 4)], "src_table string, v long").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("src_table string, v long").parquet(f"{root}/in")
    keep = lambda name: lambda df, n: seen.setdefault(name, sorted(r.v for r in df.collect()))
    ingest.dispatch(stream, f"{root}/ck", {"A": keep("A"), "other": keep("other")}).awaitTermination()
    assert seen == {"A": [1, 2], "other": [3, 4]}


def test_publish_tells_counts_and_failures(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("A", 2)], "src_table string, lsn long")
    assert ingest.publish(rows, f"file://{tmp_path}/log") == (2, None) and ingest.publish(rows.limit(0), f"file://{tmp_path}/log") == (0, None)
    bad = rows.withColumn("lsn", F.raise_error(F.lit("no")).cast("long"))
    count, why = ingest.publish(bad, f"file://{tmp_path}/log")
    assert count == 0 and why and spark.read.parquet(f"file://{tmp_path}/log").count() == 2


def test_registered_writes_have_edges_of_every_table(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    made = {tuple(r) for r in entry.queries()["cdc_graph_writes_all"](spark, "/root/testdata/sf0.001").select("kind", "label").distinct().collect()}
    assert made == {tuple(r) for r in entry.queries()["schema_list"](spark, "").collect()}
    keys = entry.queries()["cdc_synth_all"](spark, "/root/testdata/sf0.001").where("src_table = 'LINEITEM'")
    assert keys.where("primary_key RLIKE '^[0-9]+[|][0-9]+$'").count() == keys.count() > 0


def test_poll_ends_with_a_whole_lsn(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (None, "f")], "lsn long, primary_key string")
    seen, after = [], 0
    while batch := events.poll(log, after, 2).collect():
        seen, after = seen + sorted(r.primary_key for r in batch), batch[-1].lsn
    assert seen == ["a", "b", "c", "d", "e"] and events.poll(log, 0, 1).count() == 1
