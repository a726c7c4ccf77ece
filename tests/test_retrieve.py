import inspect
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from marlgraph.functions.vectors import check_dimensions, hashed_embedding, squared_l2
from marlgraph.operators import profile, retrieve
from marlgraph.operators.retrieve import Breaker, Policy, Principal

CASES = [
    ("late deliveries of one vendor", "procurement"), ("SUPPLIER audit calendar", "procurement"), ("vendor invoice and payment", "procurement"), ("open invoice total", "finance"), ("repayments by quarter", "finance"), ("payment run for stock", "finance"),
    ("immaterial changes", "inventory"), ("stocktaking at the plant", "inventory"), ("transplanted seedlings", "manufacturing"), ("Plant holidays", "manufacturing"), ("opening hours", "general"), (" ", "general"), ("", "general"),
]


@pytest.fixture(scope="module")
def vertices(spark):
    rows = [("default", 1, {"label": "Vendor", "name": "ACME supplier", "vendor_id": "V1"}), ("default", 2, {"name": "Steel supplier", "pk": "P2", "aid": "no"}), ("default", 3, {}), ("default", 4, None), ("t", 5, {"name": "supplier"}), ("default", -1, {"name": "supplier"}), ("default", 6, {"name": None, "x": "y"})]
    return spark.createDataFrame(rows, "tenant_id string, node_id long, properties map<string,string>")


def test_classify(spark):
    df = spark.createDataFrame([(q,) for q, _ in CASES], "q string").withColumn("d", retrieve.classified("q"))
    assert [r.d for r in df.collect()] == [d for _, d in CASES] == [retrieve.classify(q) for q, _ in CASES]


def test_search(vertices):
    assert rows_of(retrieve.search(vertices, "SUPPLIER", domain="d").select("node_id", "label", "domain", "sap_key")) == [(1, "Vendor", "d", "V1"), (2, "Unknown", "d", "P2")]
    assert [r.node_id for r in retrieve.search(vertices, "").collect()] == [1, 2, 6]
    assert retrieve.search(vertices, "y").first().sap_key == "Unknown-6"
    assert retrieve.search(vertices.limit(0), "y").count() == 0


def test_recall_ties_and_bad_vectors(spark):
    rows = spark.createDataFrame([(3, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (4, "a", None), (5, "a", [1.0]), (6, "a", [0.0, None]), (7, "a", [0.0, 1.0])], "node_id long, domain string, vector array<float>")
    assert [r.node_id for r in retrieve.recall(rows, [1.0, 0.0], "a", 3).collect()] == [2, 3, 7]
    with pytest.raises(ValueError, match="expected 2, found 1"):
        check_dimensions(rows, "vector", 2)
    check_dimensions(rows.where("node_id < 4"), "vector", 2)


CANDIDATE = "node_id long, label string, domain string, sap_key string, pointer_path array<string>"


def test_merge_and_access(spark):
    graph = spark.createDataFrame([(1, "G", "finance", "g1", ["A", "B"]), (2, "G", "inventory", "g2", [])], CANDIDATE)
    more = spark.createDataFrame([(2, "E", "inventory", "e2", []), (3, "E", None, "e3", []), (3, "E", None, "e3", [])], CANDIDATE)
    both = retrieve.merge(graph, more)
    assert rows_of(both.select("node_id", "label")) == [(1, "G"), (2, "G"), (3, "E")]
    p = Principal.of("p", "finance")
    assert rows_of(Policy().permitted(both, p).select("node_id")) == [(1,)] and rows_of(Policy().denied(both, p).select("node_id")) == [(2,), (3,)]
    assert Policy().permitted(both, Principal.of("x", "*")).count() == 3
    assert both.where("node_id = 1").select(retrieve.candidate_line()).first()[0] == "- G#1 key=g1 path=A > B"


def test_answer(spark, vertices):
    paths = spark.createDataFrame([("default", 1, ["Co", "U1"], "k"), ("default", 1, ["Co", "U2"], "k"), ("t", 1, ["other"], "k")], "tenant_id string, node_id long, path array<string>, sap_key string")
    every, policy = Principal.of("a", "procurement"), Policy()
    r = retrieve.answer("supplier", every, policy, vertices, paths, llm=lambda text: "said")
    assert (r.domain, r.answer, r.degraded, len(r.candidates), len(r.fragments), r.more_fragments) == ("procurement", "said", False, 2, 2, False)
    assert r.prompt.split("\n")[:3] == ["Domain: procurement", "Query: supplier", "Candidates:"] and "- procurement: Co > U1 :: " in r.prompt
    assert retrieve.answer("supplier", every, policy, vertices, paths, max_fragments=1).more_fragments
    none = retrieve.answer("vendor nothing", every, policy, vertices, llm=lambda t: 1 / 0)
    assert none.degraded and none.answer == "" and none.prompt.count("- none") == 2
    with pytest.raises(PermissionError):
        retrieve.answer("invoice", every, policy, vertices)
    with pytest.raises(ValueError):
        retrieve.answer("supplier", every, policy, vertices, use_embeddings=True)


def test_breaker():
    now, calls = [0.0], []

    def flaky(text):
        calls.append(text)
        if len(calls) % 4:
            raise OSError
        return "ok"

    assert Breaker(flaky, sleep=lambda s: None)("x") == "ok" and len(calls) == 4
    dead = Breaker(lambda t: calls.append(t) or 1 / 0, failures=2, sleep=lambda s: None, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ConnectionError):
            dead("y")
    n = len(calls)
    with pytest.raises(ConnectionError):
        dead("y")
    assert len(calls) == n  # refused without a call
    now[0] = 31
    with pytest.raises(ConnectionError):
        dead("y")
    assert len(calls) > n


def test_hashed_embedding(spark):
    embed = hashed_embedding(8)
    df = spark.createDataFrame([("a b",), ("B a",), ("",), (None,), ("word " * 20_000,)], "t string").withColumn("v", embed("t"))
    v = [r.v for r in df.collect()]
    assert v[0] == v[1] and v[2] == [0.0] * 8 and v[3] is None and len(v[4]) == 8
    assert df.limit(1).select(squared_l2("v", v[1])).first()[0] == 0


def test_profile(spark):
    tables = {
        "customers": spark.createDataFrame([(1, 10, None), (2, 10, None), (3, 11, None)], "customer_id long, address long, nothing string"),
        "addresses": spark.createDataFrame([(10, "x"), (11, "x"), (12, None)], "address_id long, city string"),
        "empty": spark.createDataFrame([], "a long, b map<string,string>"),
    }
    found = profile.profile(tables)
    assert {(t, c) for t, cs in found.items() for c, p in cs.items() if p["unique"]} == {("customers", "customer_id"), ("addresses", "address_id")}
    pairs = profile.inclusions(tables, found)
    assert pairs == [("customers", "address", "addresses", "address_id")]
    assert profile.draft_mapping(found, pairs).text().split("\n")[-1] == "EDGE LocatedAt FROM customers USING customer_id -> address"
    assert profile.edge_label("sales_items", "x", "saless") == "PartOf" and profile.edge_label("a", "SoldToParty", "b") == "HasParty_SoldToParty" and profile.primary_id("t", []) == "UNKNOWN_ID"
    assert profile.as_frame(spark, found).where(F.col("is_unique")).count() == 2


def test_inclusions_of_all_profiled_tables(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    pairs = set(map(tuple, entry.queries()["profile_fk_all"](spark, "/root/testdata/sf0.001").collect()))
    assert {("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey")} <= pairs


def test_draft_mapping_of_all_profiled_tables(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    lines = [r.statement for r in entry.queries()["profile_dsl_all"](spark, "/root/testdata/sf0.001").collect()]
    assert {x.split()[3] for x in lines if x.startswith("NODE")} == {"region", "nation", "customer", "supplier", "orders", "lineitem", "part"}
    edges = {(x.split()[3], x.split()[-1]) for x in lines if x.startswith("EDGE")}
    assert {("region", "r_regionkey"), ("customer", "c_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_suppkey")} <= edges
    assert "EDGE RefersTo_supplier_lineitem_l_suppkey FROM lineitem USING UNKNOWN_ID -> l_suppkey" in lines


def test_fragments_are_shared_among_candidates(spark, vertices):
    from marlgraph.session import GraphSession

    paths = spark.createDataFrame([("default", 1, ["Co", f"U{i}"], "k") for i in range(5)] + [("default", 2, ["Co", "V"], "k")], "tenant_id string, node_id long, path array<string>, sap_key string")
    r = retrieve.answer("supplier", Principal.of("a", "*"), Policy(), vertices, paths, max_fragments=2)
    assert [f.node_id for f in r.fragments] == [1, 2] and r.more_fragments
    every = retrieve.answer("supplier", Principal.of("a", "*"), Policy(), vertices, paths, max_fragments=6)
    assert [f.node_id for f in every.fragments] == [1] * 5 + [2] and not every.more_fragments
    assert "max_fragments" in inspect.signature(GraphSession.answer).parameters
