import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgraph.operators import store, traverse
from marlgraph.operators.retrieve import Policy, Principal
from marlgraph.plans.catalog import parse_catalog
from marlgraph.session import EDGE_LOG, VERTEX_LOG, GraphSession, NotFound
from marlgraph.sources.events import insert_events

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def edges(spark, pairs, tenant="default"):
    return spark.createDataFrame([(tenant, a, b) for a, b in pairs], "tenant_id string, src long, dst long")


def test_latest_edges_tombstones_and_ties(spark):
    log = spark.createDataFrame([
        (None, 1, 2, {"a": "1"}, None, 1), ("", 1, 2, {"a": "2"}, "put", 3), ("default", 1, 3, None, "PUT", 1), ("default", 1, 3, None, "DELETE", 2), ("default", 1, 3, {}, "PUT", 2),
        ("t", 1, 2, {}, "DELETE", 5), ("t", 1, 2, {}, "PUT", 4), (None, None, 2, {}, "PUT", 9), (None, 4, 5, None, "PUT", 1),
    ], EDGE_LOG)
    assert rows_of(store.latest_edges(log)) == [("default", 1, 2, {"a": "2"}, 3), ("default", 4, 5, None, 1)]
    assert store.latest_edges(log.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=30), st.randoms())
@SLOW
def test_adjacency_is_a_set_union_in_any_order(spark, pairs, rnd):
    rnd.shuffle(pairs)
    got = {}
    for r in store.neighbours(edges(spark, pairs), 2).orderBy("segment").collect():
        assert max(len(r.out_edges), len(r.in_edges)) <= 2
        a, b = got.setdefault(r.node_id, ([], []))
        a += r.out_edges
        b += r.in_edges
    nodes = {x for p in pairs for x in p}
    assert got == {n: (sorted({b for a, b in pairs if a == n}), sorted({a for a, b in pairs if b == n})) for n in nodes}


def test_degree_counts_every_put_at_both_ends(spark):
    assert rows_of(store.degrees(edges(spark, [(1, 2), (1, 2), (2, 2)])).drop("tenant_id")) == [(1, 2, 2, 0), (2, 4, 1, 3)]


def test_merge_runs(spark):
    runs = spark.createDataFrame([(None, 1, [1, 2], None), ("", 1, [2, 3, None], []), ("t", 1, [], []), ("t", None, [9], [])], "tenant_id string, node_id long, out_edges array<long>, in_edges array<long>")
    assert rows_of(store.merge_runs(runs)) == [("default", 1, 1), ("default", 1, 2), ("default", 1, 3)]


def test_pointer_prefix_respects_segments(spark):
    rows = spark.createDataFrame([("t", 1, ["A", "B"], "k1"), ("t", 2, ["AB", "C"], "k2"), ("t", 3, [], "k3"), ("u", 4, ["A"], "k4"), ("t", 5, ["A"], "k5")], "tenant_id string, node_id long, path array<string>, sap_key string")
    ids = lambda prefix: [r.node_id for r in store.pointer_paths(rows, "t", prefix).collect()]
    assert ids(["A"]) == [5, 1] and ids(["AB"]) == [2] and ids([]) == [3, 5, 1, 2] and ids(["X"]) == []


def fifo(pairs, anchor, depth, cap, direction):
    out, inn = {}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b), inn.setdefault(b, set()).add(a)
    seen, queue, rows = set(), [(anchor, 0)], []
    while queue:
        n, d = queue.pop(0)
        if n in seen or len(seen) >= cap:
            continue
        rows.append((n, d, len(seen)))
        seen.add(n)
        if d < depth:
            near = (sorted(out.get(n, ())) if direction != "inbound" else []) + (sorted(inn.get(n, ())) if direction != "outbound" else [])
            queue += [(x, d + 1) for x in near if x not in seen]
    return rows


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=5, max_size=40), st.integers(0, 3), st.integers(1, 8), st.sampled_from(["Outbound", "inbound", "any"]))
@SLOW
def test_bounded_search_is_the_queues(spark, pairs, depth, cap, direction):
    got = traverse.expand(edges(spark, pairs), 1, depth, cap, direction)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == fifo(pairs, 1, depth, cap, direction.lower())


def test_search_edges_cases(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert rows_of(traverse.expand(e, 1, 0)) == [(1, 0, None)]
    assert traverse.expand(e, 1, 3, 0).count() == 0
    assert rows_of(traverse.with_neighbours(traverse.expand(e, 7, 2), e)) == [(7, 0, None, 0, [], [])]
    assert rows_of(traverse.with_neighbours(traverse.expand(e, 1, 0), e)) == [(1, 0, None, 0, [2], [])]
    assert rows_of(traverse.expand(e, 1, 9)) == [(1, 0, None), (2, 1, None), (3, 2, None)]


def test_session(spark, tmp_path):
    writer = Principal.of("w", "*")
    s = GraphSession(spark, f"file://{tmp_path}/g", principal=writer, policy=Policy.of("w, x"))
    other = GraphSession(spark, f"file://{tmp_path}/g", tenant_id="t2", principal=writer, policy=Policy.of("*"))
    for a, b in [(1, 2), (1, 3), (3, 2), (1, 3)]:
        s.put_edge(a, b)
    s.put_vertex(1, {"name": "Alice"}), s.put_vertex(1, {"name": "Alice B"}), other.put_vertex(1, {"name": "Else"}), other.put_edge(1, 9)
    assert s.get_vertex(1) == {"name": "Alice B"} and other.get_vertex(1) == {"name": "Else"}
    assert rows_of(s.neighbours(1)) == [(1, 0, [2, 3], [])] and rows_of(s.neighbours(2)) == [(2, 0, [], [1, 3])] and rows_of(s.neighbours(77)) == [(77, 0, [], [])]
    assert rows_of(s.degree(spark.createDataFrame([(1,), (77,)], "node_id long"))) == [(1, 3, 3, 0), (77, 0, 0, 0)]
    s.delete_edge(1, 3)
    assert rows_of(s.neighbours(1)) == [(1, 0, [2], [])] and rows_of(s.neighbours(3)) == [(3, 0, [2], [])]
    before = rows_of(s.edges.drop("seq"))
    s.compact("edges")
    assert rows_of(s.edges.drop("seq")) == before
    assert [r.node_id for r in s.expand_neighborhood(1, 2, 10).collect()] == [1, 2]
    s.put_pointer_path(1, ["A", "B"], "k")
    assert rows_of(s.pointer_paths(["A"]).select("node_id")) == [(1,)]
    with pytest.raises(NotFound):
        s.get_vertex(5)
    with pytest.raises(ValueError):
        s.put_vertex(1 << 63, {})
    with pytest.raises(PermissionError):
        GraphSession(spark, f"file://{tmp_path}/g", policy=Policy.of("w")).put_vertex(1, {})
    with pytest.raises(PermissionError):
        GraphSession(spark, f"file://{tmp_path}/g", tenant_id="admin")


def test_compaction_changes_no_answer(spark, tmp_path):
    s = GraphSession(spark, f"file://{tmp_path}/g", principal=Principal.of("w"), policy=Policy.of("w"))
    for _ in range(3):
        s.put_edge(1, 2)
    s.put_edge(2, 1), s.put_edge(5, 6), s.delete_edge(5, 6)
    ids = spark.createDataFrame([(1,), (5,)], "node_id long")
    before, degree = rows_of(s.edges), rows_of(s.degree(ids))
    assert degree == [(1, 4, 3, 1), (5, 1, 1, 0)]
    s.compact("edges")
    assert rows_of(s.edges) == before and rows_of(s.degree(ids)) == degree
    # a put that was older than the tombstone and arrives after the compaction
    s.put_log("edges", spark.createDataFrame([("default", 5, 6, {}, "PUT", 1, "", 1)], EDGE_LOG + ", source string, written long"))
    assert rows_of(s.edges) == before and rows_of(s.degree(ids)) == [(1, 4, 3, 1), (5, 2, 2, 0)]
    s.put_edge(7, 8)
    s.compact("edges"), s.compact("edges")
    assert rows_of(s.edges.select("src", "dst")) == [(1, 2), (2, 1), (7, 8)] and rows_of(s.degree(ids)) == [(1, 4, 3, 1), (5, 2, 2, 0)]


def test_appends_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    s = GraphSession(spark, f"file://{tmp_path}/g", principal=Principal.of("w"), policy=Policy.of("w"))
    s.put_edge(1, 2)
    whole = store.compacted
    monkeypatch.setattr(store, "compacted", lambda *a: (s.put_edge(3, 4), whole(*a))[1])
    s.compact("edges")
    monkeypatch.undo()
    assert rows_of(s.edges.select("src", "dst")) == [(1, 2), (3, 4)]
    before = rows_of(s.edges)
    with pytest.raises(ZeroDivisionError):  # a compaction that dies before its commit
        monkeypatch.setattr("marlgraph.runtime.BucketedTable.publish", lambda *a: 1 / 0)
        s.compact("edges")
    monkeypatch.undo()
    assert rows_of(s.edges) == before


def test_order_of_sources(spark):
    """seq is an order within a source; between sources the one written last decides."""
    schema = EDGE_LOG + ", source string, written long"
    rows = [("t", 1, 2, {}, "PUT", 10**18, "", 100), ("t", 1, 2, None, "DELETE", 7, "ORDERS", 200), ("t", 1, 2, {}, "PUT", 5, "ORDERS", 300), ("t", 3, 4, {"a": "cdc"}, "PUT", 7, "ORDERS", 100), ("t", 3, 4, {"a": "hand"}, "PUT", 10**18, "", 200)]
    log = spark.createDataFrame(rows, schema)
    assert rows_of(store.latest_edges(log).select("src", "properties")) == [(3, {"a": "hand"})]
    once = store.compacted(log, *store.VALUES["edges"])
    assert once.count() == 4 and rows_of(store.latest_edges(once)) == rows_of(store.latest_edges(log)) and rows_of(store.degrees(once)) == rows_of(store.degrees(log))


def test_changes_win_after_a_manual_put(spark, tmp_path):
    catalog = parse_catalog("NODE A FROM a WITH id = k PROPERTIES (v) NODE B FROM b WITH id = k PROPERTIES (v)")
    s = GraphSession(spark, f"file://{tmp_path}/g", catalog, principal=Principal.of("w"), policy=Policy.of("w"))
    made = lambda table, v, lsn: spark.createDataFrame([(7, v)], "k long, v string").transform(lambda df: insert_events(df, table, ["k"])).withColumn("lsn", F.lit(lsn))
    s.ingest(made("A", "one", 1)), s.ingest(made("B", "other", 1))
    a, b = s.vertex_id("A", 7), s.vertex_id("B", 7)
    assert a != b and s.get_vertex(a)["v"] == "one" and s.get_vertex(b)["v"] == "other"
    s.put_vertex(a, {"v": "by hand"})
    assert s.get_vertex(a)["v"] == "by hand"
    s.ingest(made("A", "two", 5))
    assert s.get_vertex(a)["v"] == "two"
    s.ingest(made("A", "late", 3))
    assert s.get_vertex(a)["v"] == "two"
    s.compact("vertices")
    s.ingest(made("A", "later still", 4))
    assert s.get_vertex(a)["v"] == "two"
    s.delete_vertex(b)
    with pytest.raises(NotFound):
        s.get_vertex(b)
    again = GraphSession(spark, f"file://{tmp_path}/g", parse_catalog("NODE C FROM c WITH id = k NODE B FROM b WITH id = k"), principal=Principal.of("w"), policy=Policy.of("w"))
    assert again.vertex_id("B", 7) == b and again.vertex_id("C", 7) not in (a, b)


def test_scan_is_ordered_and_without_negatives(spark):
    log = spark.createDataFrame([("default", i, {}, "PUT", 1) for i in (5, -1, 0, 3)], VERTEX_LOG)
    assert [r.node_id for r in store.scan_vertices(store.latest_vertices(log), "default").collect()] == [0, 3, 5]
