"""Sources and sinks: the wire format, Kafka records, relational tables, publishing, embedding index, telemetry."""

import datetime as dt
import struct

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgraph.functions.vectors import hashed_embedding
from marlgraph.operators import profile, retrieve
from marlgraph.operators.retrieve import Grants, Metrics, Policy, Principal
from marlgraph.plans import executor, pattern, planner
from marlgraph.plans.catalog import parse_catalog
from marlgraph.session import GraphSession
from marlgraph.sources import tables, wire
from marlgraph.sources.events import EVENT
from marlgraph.streaming import ingest

values = st.one_of(
    st.none(), st.builds(lambda s: {"string_value": s}, st.text(max_size=8)), st.builds(lambda n: {"int_value": n}, st.integers(-(2**63), 2**63 - 1)), st.builds(lambda x: {"double_value": x}, st.floats(allow_nan=False)), st.builds(lambda b: {"bool_value": b}, st.booleans()), st.builds(lambda b: {"bytes_value": b}, st.binary(max_size=5))
)
images = st.one_of(st.none(), st.dictionaries(st.text(min_size=1, max_size=4), values, min_size=1, max_size=3))
EMPTY = dict.fromkeys(("string_value", "int_value", "double_value", "bool_value", "bytes_value"))


@given(st.text(min_size=1, max_size=6), images, images, st.integers(-(2**63), 2**63 - 1), st.one_of(st.none(), st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2100, 1, 1))))
@settings(max_examples=60, deadline=None)
def test_wire_round_trip(key, before, after, lsn, when):
    listed = lambda image: None if image is None else list(image.items())
    event = {"src_table": "T", "primary_key": key, "operation": 2, "before_image": listed(before), "after_image": listed(after), "event_ts": when, "txid": None, "lsn": lsn}
    got = wire.decode(wire.encode(event))
    assert (got["src_table"], got["primary_key"], got["operation"], got["lsn"]) == ("T", key, 2, lsn)
    for want, have in ((before, got["before_image"]), (after, got["after_image"])):
        assert (None if want is None else {k: EMPTY | (v or {}) for k, v in want.items()}) == (None if have is None else dict(have))
    assert (None if when is None else when.replace(tzinfo=dt.timezone.utc)) == got["event_ts"]


def test_wire_bytes_by_hand():
    # 1: "T", 2: "7", 3: 1, 5: {"a": int 300}, unknown 99, 8: 5
    entry = b"\x0a\x01a" + b"\x12\x03\x10\xac\x02"
    message = b"\x0a\x01T\x12\x017\x18\x01" + b"\x2a" + bytes([len(entry)]) + entry + b"\x98\x06\x2a" + b"\x40\x05"
    got = wire.decode(message)
    assert (got["src_table"], got["primary_key"], got["operation"], got["lsn"]) == ("T", "7", 1, 5) and dict(got["after_image"])["a"]["int_value"] == 300
    assert wire.decode(b"")["operation"] == 0 and wire.encode(got)[:7] == message[:7]
    for bad in (b"\x0a\x05T", b"\xff", b"\x0b", b"\x0a\x01\xff", b"\x08\x01"):
        with pytest.raises((wire.NotAMessage, UnicodeDecodeError)):
            wire.decode(bad)


def test_wire_tables(spark):
    good = wire.encode({"src_table": "T", "primary_key": "1", "operation": 3, "before_image": [("d", {"double_value": 1.5})], "after_image": None, "event_ts": dt.datetime(2024, 1, 2, 3, 4, 5, 6), "txid": "x", "lsn": 9})
    raw = spark.createDataFrame([(good,), (b"\xff\xff",), (None,), (b"",)], "value binary")
    events = wire.from_wire(raw)
    rows = events.select("src_table", "lsn", F.unix_micros("event_ts").alias("t"), F.col("before_image")["d"]["double_value"].alias("d"), F.col("corrupt").isNotNull().alias("bad")).collect()
    micros = int(dt.datetime(2024, 1, 2, 3, 4, 5, 6, dt.timezone.utc).timestamp() * 1_000_000)
    assert {tuple(r) for r in rows} == {("T", 9, micros, 1.5, False), (None, None, None, None, True), (None, None, None, None, False), (None, 0, None, None, False)}
    back = wire.to_wire(events.where("src_table = 'T'"))
    assert [(bytes(r.key), bytes(r.value)) for r in back.collect()] == [(b"T|1", good)] and wire.from_wire(raw.limit(0)).count() == 0


def test_kafka_writer_asks_for_its_connector(spark):
    events = spark.createDataFrame([], EVENT)
    assert ingest.KAFKA_WRITER == {"kafka.acks": "all", "kafka.enable.idempotence": "true"}
    with pytest.raises(Exception, match="(?i)kafka"):
        ingest.to_kafka(events, "localhost:1", "t")


def test_publishing_stops_at_the_first_failure(spark, tmp_path):
    make = lambda n: spark.range(n).select(F.lit("A").alias("src_table"), F.col("id").alias("lsn"))
    bad = make(1).withColumn("lsn", F.raise_error(F.lit("no")).cast("long"))
    path = f"file://{tmp_path}/log"
    count, why = ingest.publish_all([make(2), make(3), bad, make(4)], path)
    assert count == 5 and why and spark.read.parquet(path).count() == 5 and ingest.publish_all([], path) == (0, None)


def test_relational_tables(spark):
    """An embedded database of the JVM: all of a table, and in parallel ranges, with filters and columns pushed down."""
    url = "jdbc:derby:memory:erp;create=true"
    rows = spark.createDataFrame([(i, f"name{i}", i * 1.5) for i in range(100)], "id long, name string, price double")
    rows.write.format("jdbc").option("url", url).option("dbtable", "MATERIALS").option("createTableColumnTypes", "name VARCHAR(20)").mode("overwrite").save()
    whole = tables.jdbc_table(spark, url, "MATERIALS")
    assert whole.count() == 100
    parted = tables.jdbc_table(spark, url, "MATERIALS", partition_column="ID", bounds=(0, 100), partitions=4)
    assert parted.rdd.getNumPartitions() == 4 and rows_of(parted) == rows_of(whole)
    picked = parted.where("ID = 7").select("NAME")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert picked.collect()[0][0] == "name7" and "PushedFilters" in plan and "price" not in plan.partition("ReadSchema")[2]
    catalog = parse_catalog("NODE M FROM MATERIALS WITH id = id PROPERTIES (name)")
    plan = planner.build(pattern.parse("MATCH (m:M) WHERE m.name = 'name3' RETURN m"), catalog)
    assert [r.asDict() for r in executor.execute(plan, lambda name: tables.jdbc_table(spark, url, name), declared=True).collect()] == [{"m_id": 3, "m_name": "name3"}]


def test_declared_properties_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a", "7", 2.0)], "id long, name string, code string, extra double").write.parquet(path)
    catalog = parse_catalog("NODE T FROM t WITH id = id PROPERTIES (name, code)")

    def run(text, **more):
        return executor.execute(planner.build(pattern.parse(text), catalog), lambda name: spark.read.parquet(path), **more)

    scan = run("MATCH (t:T) RETURN t", declared=True)
    assert scan.columns == ["t_id", "t_name", "t_code"] and "extra" not in scan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(planner.PlanError):
        run("MATCH (t:T) WHERE t.extra = 2 RETURN t", declared=True)
    assert run("MATCH (t:T) WHERE t.code = 7 RETURN t").count() == 1 and run("MATCH (t:T) WHERE t.code = 7 RETURN t", strict=True).count() == 0
    assert run("MATCH (t:T) WHERE t.id = '1' RETURN t").count() == 1 and run("MATCH (t:T) WHERE t.id = '1' RETURN t", strict=True).count() == 0
    assert run("MATCH (t:T) WHERE t.id = 1 RETURN t", strict=True).count() == 1 and run("MATCH (t:T) WHERE t.extra = 2 RETURN t", strict=True).count() == 0


def test_embedding_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "valve seat"), (2, None)], "node_id long, text string")
    path = f"file://{tmp_path}/index"
    assert retrieve.index_embeddings(rows, hashed_embedding(8), 8, path).count() == 2
    retrieve.index_embeddings(rows, hashed_embedding(8), 8, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.where("vector IS NULL").count() == 2
    with pytest.raises(ValueError, match="expected 9"):
        retrieve.index_embeddings(rows, hashed_embedding(8), 9, path)
    assert spark.read.parquet(path).count() == 4


def test_metrics(spark):
    m = Metrics()
    for ms in (10, 50, 51, 9999):
        m.observe_model(ms)
    assert m.latency == [2, 1, 0, 0, 0, 0, 0, 1] and dict((r[1], r[2]) for r in m.as_rows() if r[0] == "llm_latency_ms")["+Inf"] == 4
    vertices = spark.createDataFrame([("default", 1, {"name": "supplier"})], "tenant_id string, node_id long, properties map<string,string>")
    retrieve.answer("supplier", Principal.of("p", "procurement"), Policy(), vertices, llm=lambda t: 1 / 0, metrics=m)
    vectors = spark.createDataFrame([(9, "E", "finance", "k", [], [1.0]), (8, "E", "procurement", "k", [], [1.0])], "node_id long, label string, domain string, sap_key string, pointer_path array<string>, vector array<float>")
    retrieve.answer("supplier", Principal.of("p", "procurement"), Policy(), vertices, embeddings=vectors, embed=lambda q: [1.0], use_embeddings=True, metrics=m)
    assert (m.answers, m.degraded, m.embedded) == (2, 1, 1) and sum(m.latency) == 5


def test_grants():
    some, every, none = Grants.parse(" a, b ,,"), Grants(["*", "c"]), Grants()
    assert "a" in some and "c" not in some and "anything" in every and None in every and "a" not in none and "*" not in some
    assert some == Grants(["b", "a"]) and hash(some) == hash(Grants(["b", "a"])) and every == Grants(["*", "c"]) != some


def test_telemetry(spark, tmp_path):
    s = GraphSession(spark, f"file://{tmp_path}/g", principal=Principal.of("w"), policy=Policy.of("w"))
    s.put_edge(1, 2), s.put_edge(2, 3)
    now = lambda: {r.log: r for r in s.telemetry().collect()}
    before = now()["edges"]
    s.compact("edges")
    after = now()["edges"]
    assert (before.compactions, before.compacted_rows) == (0, 0) and before.appended_files >= 2 and before.bytes > 0
    assert (after.compactions, after.compacted_rows, after.appended_files) == (1, 2, 0) and now()["paths"].bytes == 0


def test_schema_text(spark):
    assert profile.schema_text({"t": spark.createDataFrame([], "a long, b map<string,int>")}) == "t:\n  a: bigint\n  b: map<string,int>"


def test_shared_folder_is_asked_for_on_a_cluster():
    from marlgraph.runtime import is_local

    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")


def test_scratch_tables_are_removed(spark):
    from marlgraph import runtime

    held, runtime._SCRATCH[:] = runtime._SCRATCH[:], []
    try:
        table = runtime.materialize(spark.range(3), "t")
        path = runtime._SCRATCH[0].removeprefix("file://")
        assert table.count() == 3 and runtime.clean() == 1
        import os

        assert not os.path.exists(path) and runtime.clean() == 0
    finally:
        runtime._SCRATCH[:] = held


def test_doubles_keep_their_bits():
    for x in (0.1, -0.0, 1e308, struct.unpack("<d", b"\x01" + b"\0" * 7)[0]):
        v = dict(wire.decode(wire.encode(dict.fromkeys(EVENT.names) | {"after_image": [("k", {"double_value": x})], "operation": 0, "lsn": 0}))["after_image"])["k"]
        assert struct.pack("<d", v["double_value"]) == struct.pack("<d", x)
