"""Queries over patterns, the graph store, traversal, change events, retrieval and profiling, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgraph.functions.canonical import canonical_tenant
from marlgraph.functions.vectors import hashed_embedding, squared_l2
from marlgraph.operators import change_feed, profile, retrieve, store, traverse
from marlgraph.plans import executor, pattern, planner
from marlgraph.plans.catalog import parse_catalog
from marlgraph.runtime import scratch_path
from marlgraph.session import GraphSession
from marlgraph.sources import events as ev
from marlgraph.sources.tables import table
from marlgraph.streaming import ingest

MAPPING = """
NODE Customer FROM customer WITH id = c_custkey PROPERTIES (c_name, c_nationkey, c_acctbal, c_mktsegment)
NODE Order FROM orders WITH id = o_orderkey PROPERTIES (o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
NODE Part FROM part WITH id = p_partkey PROPERTIES (p_name, p_brand, p_type, p_size, p_retailprice)
NODE Supplier FROM supplier WITH id = s_suppkey PROPERTIES (s_name, s_nationkey, s_acctbal)
NODE Nation FROM nation WITH id = n_nationkey PROPERTIES (n_name, n_regionkey)
NODE Region FROM region WITH id = r_regionkey PROPERTIES (r_name)
EDGE Placed FROM orders USING o_custkey -> o_orderkey
EDGE Contains FROM lineitem USING l_orderkey -> l_partkey PROPERTIES (l_quantity, l_extendedprice)
EDGE SuppliedBy FROM lineitem USING l_partkey -> l_suppkey PROPERTIES (l_quantity)
EDGE LocatedIn FROM customer USING c_custkey -> c_nationkey
EDGE BasedIn FROM supplier USING s_suppkey -> s_nationkey
EDGE PartOf FROM nation USING n_nationkey -> n_regionkey
"""
#: Tables whose ids are unique and never null, so that a self-join over them may be dropped.
UNIQUE = frozenset({"customer", "orders", "part", "supplier", "nation", "region"})
#: Questions of our own, with the domain of the first listed word in each; the SQL takes the domains from here, not from the classifier.
QUESTIONS = [
    ("Which vendors raised their prices this spring?", "procurement"), ("list SUPPLIERS without a contract", "procurement"), ("does the vendor ship stock to every plant", "procurement"), ("unpaid invoices older than ninety days", "finance"),
    ("Payments due on Friday", "finance"), ("payment for raw material", "finance"), ("where is material 4711 kept", "inventory"), ("Overstocked bins in hall C", "inventory"), ("plants running a third shift", "manufacturing"), ("weather at the seaside", "general"), ("", "general"),
]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _match(spark: SparkSession, folder: str, text: str, extended: bool = False, unique: frozenset[str] = UNIQUE) -> DataFrame:
    plan = planner.build(pattern.parse(text, extended), parse_catalog(MAPPING), unique_ids=unique)
    return executor.execute(plan, lambda name: table(spark, folder, name))


def _columns(var: str, name: str, kinds: dict[str, list[str]]) -> str:
    return ", ".join(f"{var}.{c} AS {var}_{c}" for c in kinds[name])


_T = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _cols(*pairs: tuple[str, str]) -> str:
    return ", ".join(_columns(v, t, _T) for v, t in pairs)


# --- patterns ---------------------------------------------------------------------------------------------------------------------------

FLAGSHIP = "MATCH (c:Customer)-[:Placed]->(o:Order)-[:Contains]->(p:Part) WHERE c.c_mktsegment='BUILDING' AND p.p_brand='Brand#2' RETURN c, p"
_TWO = "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey"
_FLAG = f"SELECT {_cols(('c', 'customer'), ('p', 'part'))} {_TWO} WHERE c.c_mktsegment = 'BUILDING' AND p.p_brand = 'Brand#2'"


@_query(f"SELECT {_cols(('r', 'region'))} FROM region r")
def path_scan(spark, folder):
    return _match(spark, folder, "MATCH (r:Region) RETURN r")


@_query(f"SELECT {_cols(('c', 'customer'))} FROM customer c WHERE c_mktsegment = 'BUILDING'")
def path_filter_eq(spark, folder):
    return _match(spark, folder, "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c")


@_query(f"SELECT {_cols(('p', 'part'))} FROM part p WHERE p_size = 7")
def path_filter_int(spark, folder):
    return _match(spark, folder, "match (p:Part) where p.p_size = 7 return p")


@_query(f"SELECT {_cols(('o', 'orders'))} FROM orders o WHERE o_orderstatus = 'F' AND o_custkey = 7")
def path_and(spark, folder):
    return _match(spark, folder, "MATCH (o:Order) WHERE o.o_orderstatus = 'F' AND o.o_custkey = '7' RETURN o")


@_query(f"SELECT {_cols(('n', 'nation'), ('r', 'region'))} FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def path_one_hop(spark, folder):
    return _match(spark, folder, "MATCH (n:Nation)-[:PartOf]->(r:Region) RETURN n, r")


@_query(_FLAG)
def path_two_hop(spark, folder):
    return _match(spark, folder, FLAGSHIP)


@_query(_FLAG)
def path_self_join_kept(spark, folder):
    """The flagship without dropping the self-join of orders; the same rows."""
    return _match(spark, folder, FLAGSHIP, unique=frozenset())


@_query(f"SELECT {_cols(('c', 'customer'), ('s', 'supplier'))} {_TWO} JOIN lineitem l2 ON p.p_partkey = l2.l_partkey JOIN supplier s ON l2.l_suppkey = s.s_suppkey WHERE c.c_custkey = 8 AND p.p_brand = 'Brand#2'")
def path_three_hop(spark, folder):
    """Three hops from one customer; path_three_hop_all starts from every customer."""
    return _match(spark, folder, "MATCH (c:Customer)-[:Placed]->(o:Order)-[:Contains]->(p:Part)-[x:SuppliedBy]->(s:Supplier) WHERE c.c_custkey = 8 AND p.p_brand = 'Brand#2' RETURN c, s")


@_query(f"SELECT {_cols(('c', 'customer'), ('s', 'supplier'))} {_TWO} JOIN lineitem l2 ON p.p_partkey = l2.l_partkey JOIN supplier s ON l2.l_suppkey = s.s_suppkey WHERE p.p_brand = 'Brand#2'")
def path_three_hop_all(spark, folder):
    return _match(spark, folder, "MATCH (c:Customer)-[:Placed]->(o:Order)-[:Contains]->(p:Part)-[x:SuppliedBy]->(s:Supplier) WHERE p.p_brand = 'Brand#2' RETURN c, s")


@_query(f"SELECT {_cols(('e', 'lineitem'))} FROM orders o JOIN lineitem e ON o.o_orderkey = e.l_orderkey JOIN part p ON e.l_partkey = p.p_partkey WHERE p.p_brand = 'Brand#3' AND o.o_orderstatus = 'O'")
def path_edge_var(spark, folder):
    return _match(spark, folder, "MATCH (o:Order)-[e:Contains]->(p:Part) WHERE p.p_brand = 'Brand#3' AND o.o_orderstatus = 'O' RETURN e")


@_query(f"SELECT {_cols(('s', 'supplier'), ('n', 'nation'))} FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def path_anon_edge(spark, folder):
    return _match(spark, folder, "MATCH (s:Supplier)-[:BasedIn]->(n:Nation) RETURN s, n")


@_query(f"SELECT {_cols(('n', 'nation'))} FROM nation n ORDER BY n_nationkey LIMIT 5")
def path_limit(spark, folder):
    return _match(spark, folder, "MATCH (n:Nation) RETURN n").orderBy("n_n_nationkey").limit(5)


@_query("SELECT least(count(*), 7) AS n, true AS real FROM nation")
def path_limit_clause(spark, folder):
    """The pattern's own LIMIT: seven rows, each of them a nation. Which ones is open, so they are counted."""
    rows = _match(spark, folder, "MATCH (n:Nation) RETURN n LIMIT 7")
    whole = table(spark, folder, "nation").select(F.col("n_nationkey").alias("n_n_nationkey"), F.lit(True).alias("there"))
    return rows.join(whole, "n_n_nationkey", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("real"))


@_query(f"SELECT {_cols(('c', 'customer'))} FROM customer c WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def path_in(spark, folder):
    return _match(spark, folder, "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c", True)


@_query(f"SELECT {_cols(('p', 'part'), ('o', 'orders'))} FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE p.p_partkey = 8")
def path_reverse(spark, folder):
    """A hop against its direction from one part; path_reverse_all starts from every part."""
    return _match(spark, folder, "MATCH (p:Part)<-[:Contains]-(o:Order) WHERE p.p_partkey = 8 RETURN p, o", True)


@_query(f"SELECT {_cols(('p', 'part'), ('o', 'orders'))} FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey")
def path_reverse_all(spark, folder):
    return _match(spark, folder, "MATCH (p:Part)<-[:Contains]-(o:Order) RETURN p, o", True)


@_query(f"SELECT {_cols(('a', 'nation'), ('b', 'nation'))} FROM nation a JOIN (SELECT n_nationkey x, n_regionkey y FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation) e ON a.n_nationkey = e.x JOIN nation b ON e.y = b.n_nationkey")
def path_both(spark, folder):
    return _match(spark, folder, "MATCH (a:Nation)-[:PartOf]-(b:Nation) RETURN a, b", True)


@_query("SELECT c.c_name AS name, c.c_acctbal AS c_c_acctbal, n.n_name AS nation FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def path_project_alias(spark, folder):
    return _match(spark, folder, "MATCH (c:Customer)-[:LocatedIn]->(n:Nation) RETURN c.c_name AS name, c.c_acctbal, n.n_name AS nation", True)


@_query("SELECT o.o_orderkey o_o_orderkey, o.o_custkey o_o_custkey, o.o_orderstatus o_o_orderstatus, o.o_totalprice o_o_totalprice, o.o_orderdate o_o_orderdate, o.o_orderpriority o_o_orderpriority, e.l_orderkey e_l_orderkey, e.l_partkey e_l_partkey, e.l_quantity e_l_quantity, e.l_extendedprice e_l_extendedprice FROM orders o JOIN lineitem e ON o.o_orderkey = e.l_orderkey JOIN part p ON e.l_partkey = p.p_partkey WHERE p.p_size = 7")
def path_declared(spark, folder):
    """Variables with their declared properties only: of lineitem four columns are read and come out."""
    plan = planner.build(pattern.parse("MATCH (o:Order)-[e:Contains]->(p:Part) WHERE p.p_size = 7 RETURN o, e"), parse_catalog(MAPPING), unique_ids=UNIQUE)
    return executor.execute(plan, lambda name: table(spark, folder, name), declared=True)


@_query(f"SELECT {_cols(('o', 'orders'))} FROM orders o WHERE o_orderstatus = 'F'")
def path_strict(spark, folder):
    """Conditions without conversion: a text never equals a number."""
    plan = planner.build(pattern.parse("MATCH (o:Order) WHERE o.o_orderstatus = 'F' RETURN o"), parse_catalog(MAPPING), unique_ids=UNIQUE)
    return executor.execute(plan, lambda name: table(spark, folder, name), strict=True)


@_query("SELECT n_nationkey::VARCHAR n_n_nationkey, n_name n_n_name, n_regionkey::VARCHAR n_n_regionkey FROM nation")
def path_utf8(spark, folder):
    return executor.all_strings(_match(spark, folder, "MATCH (n:Nation) RETURN n"))


@_query("SELECT * FROM (VALUES ('edge','BasedIn'),('edge','Contains'),('edge','LocatedIn'),('edge','PartOf'),('edge','Placed'),('edge','SuppliedBy'),('node','Customer'),('node','Nation'),('node','Order'),('node','Part'),('node','Region'),('node','Supplier')) t(kind, label)")
def schema_list(spark, folder):
    return parse_catalog(MAPPING).as_frame(spark)


# --- store ------------------------------------------------------------------------------------------------------------------------------

_ENDS = [
    ("orders", "o_custkey * 8", "o_orderkey * 8 + 1"),
    ("lineitem", "l_orderkey * 8 + 1", "l_partkey * 8 + 2"),
    ("lineitem", "l_partkey * 8 + 2", "l_suppkey * 8 + 3"),
    ("customer", "c_custkey * 8", "c_nationkey * 8 + 4"),
    ("supplier", "s_suppkey * 8 + 3", "s_nationkey * 8 + 4"),
    ("nation", "n_nationkey * 8 + 4", "n_regionkey * 8 + 5"),
]
_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT ({a})::BIGINT src, ({b})::BIGINT dst FROM {t}" for t, a, b in _ENDS) + ")"
_G = f"{_RAW}, g AS (SELECT DISTINCT src, dst FROM raw)"


def _puts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit("default").alias("tenant_id"), F.expr(a).cast("long").alias("src"), F.expr(b).cast("long").alias("dst")) for t, a, b in _ENDS]
    return reduce(DataFrame.unionByName, parts)


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return _puts(spark, folder).distinct()


def _vertex_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vertex_writes").select("tenant_id", "node_id", "properties", "op", F.col("write_id").alias("seq"))


def _edge_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "edge_writes")
    return rows.select("tenant_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "properties", "op", F.col("request_id").alias("seq"))


_TEN = "CASE WHEN tenant_id IS NULL OR tenant_id = '' THEN 'default' ELSE tenant_id END"
_DEL = "coalesce(upper(trim(op)), 'PUT') = 'DELETE'"
_LV = f"lv AS (SELECT t tenant_id, node_id, max(write_id) seq FROM (SELECT *, {_TEN} t FROM vertex_writes) WHERE node_id IS NOT NULL GROUP BY ALL HAVING NOT arg_max({_DEL}, write_id))"
_LE = f"le AS (SELECT t tenant_id, source_id src, target_id dst, max(request_id) seq FROM (SELECT *, {_TEN} t FROM edge_writes) WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL HAVING NOT arg_max({_DEL}, (request_id, {_DEL})))"


@_query(f"WITH {_LV} SELECT lv.*, coalesce(list_extract(map_extract(v.properties, 'label'), 1), '') AS label FROM lv JOIN (SELECT DISTINCT write_id, properties FROM vertex_writes) v ON v.write_id = lv.seq")
def store_vertex_latest(spark, folder):
    rows = store.latest_vertices(_vertex_log(spark, folder))
    return rows.select("tenant_id", "node_id", "seq", F.coalesce(F.try_element_at("properties", F.lit("label")), F.lit("")).alias("label"))


@_query(f"WITH {_LV} SELECT node_id, seq FROM lv WHERE tenant_id = 'default' AND node_id >= 0")
def store_scan_vertices(spark, folder):
    return store.scan_vertices(store.latest_vertices(_vertex_log(spark, folder)), "default").select("node_id", "seq")


@_query("SELECT c_custkey * 8 node_id, c_name AS name FROM customer WHERE c_custkey = 5")
def store_get_vertex(spark, folder):
    rows = table(spark, folder, "customer").select(F.lit("default").alias("tenant_id"), (F.col("c_custkey") * 8).alias("node_id"), F.col("c_name").alias("name"))
    return store.get_vertex(rows, "default", 40).drop("tenant_id")


@_query(f"WITH {_LV}, f AS (SELECT min(node_id) node_id FROM lv WHERE tenant_id = 'default') SELECT lv.* FROM lv JOIN f USING (node_id) WHERE tenant_id = 'default'")
def store_get_vertex_log(spark, folder):
    """The first live vertex of the default tenant, by its id, through the view over the log."""
    vertices = store.latest_vertices(_vertex_log(spark, folder))
    first = vertices.where("tenant_id = 'default'").agg(F.min("node_id")).first()[0]
    return store.get_vertex(vertices, "default", -1 if first is None else first).select("tenant_id", "node_id", "seq")


@_query(f"WITH {_LE} SELECT * FROM le")
def store_edge_latest(spark, folder):
    return store.latest_edges(_edge_log(spark, folder)).select("tenant_id", "src", "dst", "seq")


@_query(f"WITH {_LE} SELECT tenant_id, src node_id, count(*) live FROM le GROUP BY ALL")
def store_edge_delete(spark, folder):
    """Live out-edges per vertex after tombstones."""
    return store.latest_edges(_edge_log(spark, folder)).groupBy("tenant_id", F.col("src").alias("node_id")).agg(F.count("*").alias("live"))


@_query(f"WITH {_LE}, f AS (SELECT tenant_id, src, dst FROM le WHERE tenant_id = 'default' ORDER BY src, dst LIMIT 1) SELECT le.* FROM le JOIN f USING (tenant_id, src, dst)")
def store_get_edge(spark, folder):
    """The first edge of the default tenant, by its key."""
    edges = store.latest_edges(_edge_log(spark, folder))
    key = edges.where("tenant_id = 'default'").orderBy("src", "dst").first()
    return store.get_edge(edges, "default", key["src"] if key else -1, key["dst"] if key else -1).select("tenant_id", "src", "dst", "seq")


_SIDE = "string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (dir = {})"


@_query(f"WITH {_G}, p AS (SELECT *, (row_number() OVER (PARTITION BY n, dir ORDER BY o) - 1) // 1000 seg FROM (SELECT src n, 0 dir, dst o FROM g UNION ALL SELECT dst, 1, src FROM g)) SELECT n node_id, seg::BIGINT segment, {_SIDE.format(0)} out_edges, {_SIDE.format(1)} in_edges FROM p GROUP BY n, seg")
def store_neighbors(spark, folder):
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return store.neighbours(_puts(spark, folder)).select("node_id", "segment", text("out_edges").alias("out_edges"), text("in_edges").alias("in_edges"))


@_query(f"WITH {_G} SELECT dst node_id, count(*) sources, min(src) first_source FROM g GROUP BY 1")
def store_in_edges(spark, folder):
    rows = store.both_ends(_edges(spark, folder)).where("dir = 1")
    return rows.groupBy("node_id").agg(F.count("*").alias("sources"), F.min("other").alias("first_source"))


@_query(f"WITH {_RAW} SELECT n node_id, count(*) degree, count(*) FILTER (d = 0) out_degree, count(*) FILTER (d = 1) in_degree FROM (SELECT src n, 0 d FROM raw UNION ALL SELECT dst, 1 FROM raw) GROUP BY 1")
def store_degree(spark, folder):
    return store.degrees(_puts(spark, folder)).drop("tenant_id")


@_query(f"WITH {_RAW} SELECT n node_id, count(*) degree FROM (SELECT src n FROM raw UNION ALL SELECT dst FROM raw) GROUP BY 1 HAVING count(*) > 500")
def store_supernodes(spark, folder):
    return store.super_nodes(store.degrees(_puts(spark, folder)), 500).select("node_id", "degree")


@_query("SELECT t tenant_id, count(*) vertices, count(DISTINCT p) principals FROM (SELECT CASE WHEN tenant_id IS NULL OR tenant_id = '' THEN 'default' ELSE tenant_id END t, principal p FROM vertex_writes) GROUP BY 1")
def store_tenants(spark, folder):
    rows = table(spark, folder, "vertex_writes").withColumn("tenant_id", canonical_tenant("tenant_id"))
    return rows.groupBy("tenant_id").agg(F.count("*").alias("vertices"), F.countDistinct("principal").alias("principals"))


@_query(f"SELECT t tenant_id, node_id, count(DISTINCT o) neighbours, min(o) lowest, max(o) highest FROM (SELECT {_TEN} t, node_id, unnest(out_edges) o FROM adjacency_runs WHERE node_id IS NOT NULL) WHERE o IS NOT NULL GROUP BY ALL")
def store_tier_merge(spark, folder):
    merged = store.merge_runs(table(spark, folder, "adjacency_runs"))
    return merged.groupBy("tenant_id", "node_id").agg(F.count("*").alias("neighbours"), F.min("other").alias("lowest"), F.max("other").alias("highest"))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.lit("default").alias("tenant_id"), (F.col("c_custkey") * 8).alias("node_id"), F.array("r_name", "n_name", "c_name").alias("path"), F.col("c_name").alias("sap_key"))


@_query("SELECT c_custkey * 8 node_id, r_name || ' > ' || n_name || ' > ' || c_name AS path, c_name sap_key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def store_pointer_prefix(spark, folder):
    rows = store.pointer_paths(store.with_path_key(_paths(spark, folder)), "default", ["ASIA"])
    return rows.select("node_id", F.array_join("path", " > ").alias("path"), "sap_key")


@_query("SELECT 'each source in one shard' AS rule, true AS holds")
def store_shards(spark, folder):
    """All edges of a source must fall into one of 16 shards."""
    spread = _puts(spark, folder).withColumn("shard", store.shard("src", 16)).groupBy("src").agg(F.min("shard").alias("a"), F.max("shard").alias("b"))
    return spread.agg(F.coalesce(F.bool_and((F.col("a") == F.col("b")) & F.col("a").between(0, 15)), F.lit(True)).alias("holds")).select(F.lit("each source in one shard").alias("rule"), "holds")


@_query(f"WITH {_RAW} SELECT count(*) edges, count(DISTINCT src) sources, 16::BIGINT shards, count(DISTINCT src) source_shards FROM raw")
def store_shard_counts(spark, folder):
    """Edges and sources over all 16 shards: every shard has some, and pairs of source and shard are as many as sources."""
    rows = _puts(spark, folder).select("src", store.shard("src", 16).alias("shard"))
    return rows.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("shard").alias("shards"), F.count_distinct("src", "shard").alias("source_shards"))


# --- traversal --------------------------------------------------------------------------------------------------------------------------

_BFS = "WITH RECURSIVE {g}, s AS ({s}), b(node, depth) AS (SELECT 8::BIGINT, 0 UNION SELECT s.b, b.depth + 1 FROM b JOIN s ON s.a = b.node WHERE b.depth < {d}) SELECT node node_id, min(depth) AS depth FROM b GROUP BY 1"


@_query(_BFS.format(g=_G, s="SELECT src a, dst b FROM g", d=3))
def bfs_out(spark, folder):
    return traverse.expand(_puts(spark, folder), 8, 3).select("node_id", "depth")


@_query(_BFS.format(g=_G, s="SELECT dst a, src b FROM g", d=2).replace("8::BIGINT", "12::BIGINT"))
def bfs_in(spark, folder):
    return traverse.expand(_puts(spark, folder), 12, 2, direction="INBOUND").select("node_id", "depth")


@_query(_BFS.format(g=_G, s="SELECT src a, dst b FROM g UNION SELECT dst, src FROM g", d=2))
def bfs_both(spark, folder):
    return traverse.expand(_puts(spark, folder), 8, 2, direction="both").select("node_id", "depth")


def _capped_sql(anchor: int, depth: int, cap: int) -> str:
    """The levels of a search in both directions one after another, each cut to what is left of the cap, then the visited vertices' neighbour lists."""
    steps = f"WITH {_G}, s AS (SELECT src a, 0 dir, dst b FROM g UNION ALL SELECT dst, 1, src FROM g), v0 AS (SELECT {anchor}::BIGINT node, 0 AS depth, 0::BIGINT AS rank)"
    for k in range(1, depth + 1):
        first = f"SELECT b, l.rank p, dir, row_number() OVER (PARTITION BY b ORDER BY l.rank, dir) r FROM (SELECT * FROM v{k - 1} WHERE depth = {k - 1}) l JOIN s ON s.a = l.node WHERE b NOT IN (SELECT node FROM v{k - 1})"
        steps += f", n{k} AS (SELECT b, (SELECT count(*) FROM v{k - 1}) + row_number() OVER (ORDER BY p, dir, b) - 1 rank FROM ({first}) WHERE r = 1), v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT b, {k}, rank FROM n{k} WHERE rank < {cap})"
    lists = "p AS (SELECT a, dir, b, (row_number() OVER (PARTITION BY a, dir ORDER BY b) - 1) // 1000 seg FROM s)"
    side = "coalesce(string_agg(b::VARCHAR, ',' ORDER BY b) FILTER (dir = {}), '')"
    return f"{steps}, {lists} SELECT node node_id, depth, rank, coalesce(seg, 0)::BIGINT segment, {side.format(0)} out_edges, {side.format(1)} in_edges FROM v{depth} LEFT JOIN p ON a = node GROUP BY node, depth, rank, seg"


@_query(_capped_sql(8, 3, 40))
def bfs_capped(spark, folder):
    """With a cap of 40 vertices, ranks and neighbour lists."""
    edges = _puts(spark, folder)
    rows = traverse.with_neighbours(traverse.expand(edges, 8, 3, 40, "both"), edges, "both")
    return rows.select("node_id", "depth", "rank", "segment", F.array_join("out_edges", ",").alias("out_edges"), F.array_join("in_edges", ",").alias("in_edges"))


# --- change events ----------------------------------------------------------------------------------------------------------------------

_OPS = "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END"


def _user_events(spark: SparkSession, folder: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 3).otherwise(2)
    return table(spark, folder, "events").select(F.lit("USERS").alias("src_table"), F.col("user_id").cast("string").alias("primary_key"), op.alias("operation"), F.col("event_id").alias("lsn"), "value")


_KEYS = r"upper(trim(src_table)) src_table, regexp_replace(upper(trim(primary_key)), '(^|\|)0+([^|])', '\1\2', 'g') primary_key"


@_query(f"SELECT DISTINCT {_KEYS}, lsn FROM cdc_events")
def cdc_dedup(spark, folder):
    from marlgraph.functions.canonical import canonical_key, canonical_table

    rows = table(spark, folder, "cdc_events").select(canonical_table("src_table").alias("src_table"), canonical_key("primary_key").alias("primary_key"), "lsn")
    return ingest.drop_repeats(rows)


@_query(f"SELECT DISTINCT {_KEYS}, lsn FROM cdc_events")
def cdc_stream_dedup(spark, folder):
    """The same over a stream with checkpointed state."""
    from marlgraph.functions.canonical import canonical_key, canonical_table

    path = f"{folder}/cdc_events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    rows = stream.select(canonical_table("src_table").alias("src_table"), canonical_key("primary_key").alias("primary_key"), "lsn")
    root = scratch_path(spark, "stream")
    ingest.append_to_log(ingest.drop_repeats(rows), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/log")


@_query(f"SELECT user_id::VARCHAR pk, max(event_id) lsn, round(arg_max(value, event_id), 4) v FROM events GROUP BY 1 HAVING arg_max({_OPS}, event_id) <> 3")
def cdc_latest(spark, folder):
    rows = change_feed.apply_changes(_user_events(spark, folder), ["primary_key"], "lsn", "operation", F.col("value").cast("string"))
    return rows.select(F.col("primary_key").alias("pk"), F.col("_seq").alias("lsn"), F.round(F.col("_payload").cast("double"), 4).alias("v"))


@_query("SELECT event_id lsn, user_id::VARCHAR primary_key FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 1000")
def cdc_poll(spark, folder):
    return ev.poll(_user_events(spark, folder), 100, 1000).select("lsn", "primary_key")


@_query(r"""WITH k AS (SELECT primary_key pk, string_split(primary_key, '|') p FROM cdc_events)
SELECT CASE WHEN regexp_matches(pk, '^[0-9]+$') THEN pk::BIGINT WHEN len(p) = 2 AND regexp_matches(p[1], '^[0-9]+$') AND regexp_matches(p[2], '^[0-9]+$') THEN p[1]::BIGINT ELSE 1 END src,
CASE WHEN regexp_matches(pk, '^[0-9]+$') THEN pk::BIGINT + 1 WHEN len(p) = 2 AND regexp_matches(p[1], '^[0-9]+$') AND regexp_matches(p[2], '^[0-9]+$') THEN p[2]::BIGINT ELSE 2 END dst, count(*) n FROM k GROUP BY ALL""")
def cdc_edge_map(spark, folder):
    return ev.edges_of_keys(table(spark, folder, "cdc_events")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("""SELECT f AS field, count(v.string_value) strings, count(v.int_value) ints, count(v.double_value) doubles, count(v.bool_value) bools, count(coalesce(v.string_value, v.int_value::VARCHAR, v.double_value::VARCHAR, v.bool_value::VARCHAR, to_base64(v.bytes_value))) texts
FROM (SELECT unnest(map_keys(after_image)) f, unnest(map_values(after_image)) v FROM cdc_events) GROUP BY 1""")
def cdc_value_coerce(spark, folder):
    """Typed values of the row images, per field."""
    rows = table(spark, folder, "cdc_events").select(F.explode("after_image").alias("field", "v"))
    n = lambda c: F.count(f"v.{c}_value")
    return rows.groupBy("field").agg(n("string").alias("strings"), n("int").alias("ints"), n("double").alias("doubles"), n("bool").alias("bools"), F.count(ev.value_text(F.col("v"))).alias("texts"))


@_query("SELECT 'SUPPLIER' AS src_table, s_suppkey::VARCHAR AS primary_key, row_number() OVER (ORDER BY s_suppkey) AS lsn, s_name AS name, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier")
def cdc_synth(spark, folder):
    """Insert events of one table with their values; cdc_synth_all has those of all mapped tables."""
    rows = ev.insert_events(table(spark, folder, "supplier"), "SUPPLIER", ["s_suppkey"])
    v = lambda c: F.try_element_at("after_image", F.lit(c))
    return rows.select("src_table", "primary_key", "lsn", v("s_name")["string_value"].alias("name"), v("s_nationkey")["int_value"].alias("nation"), v("s_acctbal")["double_value"].alias("balance"))


@_query("SELECT 'Supplier' AS label, s_suppkey::BIGINT node_id, s_name AS name FROM supplier")
def cdc_graph_writes(spark, folder):
    """Vertices that the catalog makes of one table's insert events; cdc_graph_writes_all has vertices and edges of all."""
    made = ev.insert_events(table(spark, folder, "supplier"), "SUPPLIER", ["s_suppkey"])
    vertices, _ = ev.graph_writes(made, parse_catalog(MAPPING))
    p = lambda c: F.try_element_at("properties", F.lit(c))
    return store.latest_vertices(vertices).select(p("label").alias("label"), _key("node_id").alias("node_id"), p("s_name").alias("name"))


def _key(node_id: str) -> F.Column:
    """The table's key in a vertex id."""
    return F.floor(F.col(node_id) / parse_catalog(MAPPING).width()).cast("long")


#: Key columns of the mapped tables.
_TABLE_KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def _all_inserts(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [ev.insert_events(table(spark, folder, t), t.upper(), keys) for t, keys in _TABLE_KEYS.items()])


@_query(" UNION ALL ".join(f"SELECT '{t.upper()}' AS src_table, concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in keys)}) AS primary_key, row_number() OVER (ORDER BY {', '.join(keys)}) AS lsn, {len(_T[t])}::INTEGER AS fields FROM {t}" for t, keys in _TABLE_KEYS.items()))
def cdc_synth_all(spark, folder):
    """Insert events of all mapped tables, each numbered from 1 in order of its key, lineitem by two columns."""
    return _all_inserts(spark, folder).select("src_table", "primary_key", "lsn", F.size("after_image").alias("fields"))


@_query(" UNION ALL ".join(
    [f"SELECT 'node' AS kind, '{m.label}' AS label, {m.id_column}::BIGINT AS src, NULL::BIGINT AS dst FROM {m.table}" for m in parse_catalog(MAPPING).nodes.values()]
    + [f"SELECT 'edge', '{m.label}', {m.source_column}::BIGINT, {m.target_column}::BIGINT FROM {m.table}" for m in parse_catalog(MAPPING).edges.values()]
))
def cdc_graph_writes_all(spark, folder):
    """Vertex and edge writes that the catalog makes of the insert events of all mapped tables, one row per write."""
    vertices, edges = ev.graph_writes(_all_inserts(spark, folder), parse_catalog(MAPPING))
    label = F.try_element_at("properties", F.lit("label")).alias("label")
    return vertices.select(F.lit("node").alias("kind"), label, _key("node_id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select(F.lit("edge").alias("kind"), label, _key("src").alias("src"), _key("dst").alias("dst")))


@_query(" UNION ALL ".join(f"SELECT '{m.label}' AS label, count(DISTINCT {m.id_column}) AS vertices, min({m.id_column})::BIGINT AS lowest, max({m.id_column})::BIGINT AS highest FROM {m.table}" for m in parse_catalog(MAPPING).nodes.values()))
def graph_two_labels(spark, folder):
    """Vertices of every label after ingestion of all tables; keys that several tables have are different vertices."""
    vertices, _ = ev.graph_writes(_all_inserts(spark, folder), parse_catalog(MAPPING))
    rows = store.latest_vertices(vertices).withColumn("key", _key("node_id"))
    return rows.groupBy(F.try_element_at("properties", F.lit("label")).alias("label")).agg(F.count("*").alias("vertices"), F.min("key").alias("lowest"), F.max("key").alias("highest"))


@_query("SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS src, o_orderkey AS dst FROM orders")
def graph_edge_moved(spark, folder):
    """Edges from customers to orders after every order of status F went to the next customer: the old edges are gone."""
    made = ev.insert_events(table(spark, folder, "orders"), "ORDERS", ["o_orderkey"])
    moved = F.transform_values("after_image", lambda k, v: F.when(k == "o_custkey", v.withField("int_value", v["int_value"] + 1)).otherwise(v))
    updates = made.where(F.try_element_at("after_image", F.lit("o_orderstatus"))["string_value"] == "F").withColumns({"operation": F.lit(2), "before_image": F.col("after_image"), "after_image": moved, "lsn": F.col("lsn") + (1 << 40)})
    _, edges = ev.graph_writes(made.unionByName(updates), parse_catalog(MAPPING))
    return store.latest_edges(edges).select(_key("src").alias("src"), _key("dst").alias("dst"))


@_query(f"""WITH {_LE}, p AS (SELECT {_TEN} tenant_id, source_id src, target_id dst FROM edge_writes WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND NOT {_DEL})
SELECT tenant_id, n node_id, coalesce(max(live), 0)::BIGINT live_out, count(*) degree FROM (SELECT tenant_id, src n FROM p UNION ALL SELECT tenant_id, dst FROM p) LEFT JOIN (SELECT tenant_id, src n, count(*) live FROM le GROUP BY ALL) USING (tenant_id, n) GROUP BY ALL""")
def store_compacted(spark, folder):
    """Live out-edges and degree of every vertex from a log that came in two parts, the later one first, and was compacted after each."""
    graph = GraphSession(spark, scratch_path(spark, "graph"), principal=retrieve.Principal.of("loader"), policy=retrieve.Policy.of("loader"))
    log = _edge_log(spark, folder)
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for part in (F.col("seq") > middle, F.coalesce(F.col("seq") <= middle, F.lit(True))):
        graph.put_log("edges", log.where(part))
        graph.compact("edges")
    live = graph.edges.groupBy("tenant_id", F.col("src").alias("node_id")).agg(F.count("*").alias("live_out"))
    degree = store.degrees(graph._log("edges")).select("tenant_id", "node_id", "degree")
    return degree.join(live, ["tenant_id", "node_id"], "left").select("tenant_id", "node_id", F.coalesce("live_out", F.lit(0)).alias("live_out"), "degree")


# --- retrieval --------------------------------------------------------------------------------------------------------------------------

_V = """v AS (SELECT c_custkey * 8 node_id, 'Customer' AS label, c_name sap_key, [c_name, c_mktsegment, 'Customer'] vals FROM customer
  UNION ALL SELECT p_partkey * 8 + 2, 'Part', p_name, [p_name, p_brand, p_type, 'Part'] FROM part)"""
_HIT = "len(list_filter(vals, lambda x: contains(lower(x), '{}'))) > 0"


def _catalog_vertices(spark: SparkSession, folder: str) -> DataFrame:
    c, p = table(spark, folder, "customer"), table(spark, folder, "part")
    props = lambda label, key, names: F.create_map(F.lit("label"), F.lit(label), F.lit("pk"), F.col(key), *[x for n in names for x in (F.lit(n), F.col(n))])
    one = c.select(F.lit("default").alias("tenant_id"), (F.col("c_custkey") * 8).alias("node_id"), props("Customer", "c_name", ["c_mktsegment"]).alias("properties"))
    return one.unionByName(p.select(F.lit("default").alias("tenant_id"), (F.col("p_partkey") * 8 + 2).alias("node_id"), props("Part", "p_name", ["p_brand", "p_type"]).alias("properties")))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{d}')" for q, d in QUESTIONS) + ") t(question, domain)")
def rag_classify(spark, folder):
    return spark.createDataFrame([(q,) for q, _ in QUESTIONS], "question string").withColumn("domain", retrieve.classified("question"))


@_query("SELECT CASE WHEN t LIKE '%supplier%' OR t LIKE '%vendor%' THEN 'procurement' WHEN t LIKE '%invoice%' OR t LIKE '%payment%' THEN 'finance' WHEN t LIKE '%material%' OR t LIKE '%stock%' THEN 'inventory' WHEN t LIKE '%plant%' THEN 'manufacturing' ELSE 'general' END AS domain, count(*) n FROM (SELECT lower(text) t FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def rag_classify_texts(spark, folder):
    """Domains of all documents."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    return rows.groupBy(retrieve.classified("text").alias("domain")).agg(F.count("*").alias("n"))


@_query(f"WITH {_V} SELECT node_id, label, sap_key FROM v WHERE {_HIT.format('build')} ORDER BY node_id LIMIT 51")
def rag_candidates(spark, folder):
    return retrieve.search(_catalog_vertices(spark, folder), "Build").select("node_id", "label", "sap_key")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit("Doc").alias("label"), F.col("label").cast("string").alias("domain"), F.concat(F.lit("DOC-"), "vec_id").alias("sap_key"), F.array().cast("array<string>").alias("pointer_path"), F.col("embedding").alias("vector"))
    return rows, rows.where("node_id = 0").first()["vector"]


_TOP = """WITH q AS (SELECT embedding v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) d FROM embeddings, q WHERE label = 3)"""


@_query(f"{_TOP} SELECT vec_id, round(d, 4) d FROM s ORDER BY s.d, vec_id LIMIT 20")
def vector_topk(spark, folder):
    rows, query = _vectors(spark, folder)
    return retrieve.recall(rows, query, "3").select(F.col("node_id").alias("vec_id"), F.round("distance", 4).alias("d"))


@_query("SELECT len(embedding)::INTEGER AS dim, count(*) n FROM embeddings GROUP BY 1")
def vector_dims(spark, folder):
    from marlgraph.functions.vectors import check_dimensions

    rows = table(spark, folder, "embeddings")
    check_dimensions(rows, "embedding", 64)
    return rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


_HYBRID = f"""{_TOP}, {_V}, top AS (SELECT vec_id FROM s ORDER BY d, vec_id LIMIT 20), c AS (SELECT node_id, label, sap_key, CASE label WHEN 'Part' THEN 'inventory' ELSE 'finance' END AS domain FROM v WHERE {_HIT.format('build')} ORDER BY node_id LIMIT 51),
m AS (SELECT * FROM c UNION ALL SELECT vec_id, 'Doc', 'DOC-' || vec_id, '3' FROM top WHERE vec_id NOT IN (SELECT node_id FROM c))"""


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows, query = _vectors(spark, folder)
    found = retrieve.search(_catalog_vertices(spark, folder), "build").withColumn("domain", F.when(F.col("label") == "Part", "inventory").otherwise("finance"))
    return retrieve.merge(found, retrieve.recall(rows, query, "3"))


@_query(f"{_HYBRID} SELECT * FROM m")
def rag_hybrid(spark, folder):
    return _hybrid(spark, folder).drop("pointer_path")


@_query(f"{_HYBRID} SELECT node_id, domain FROM m WHERE domain IN ('3', 'inventory')")
def rag_rbac(spark, folder):
    return retrieve.Policy().permitted(_hybrid(spark, folder), retrieve.Principal.of("p", "3", "inventory")).select("node_id", "domain")


@_query(f"{_HYBRID} SELECT node_id, sap_key FROM m WHERE domain NOT IN ('3', 'inventory')")
def rag_denied(spark, folder):
    return retrieve.Policy().denied(_hybrid(spark, folder), retrieve.Principal.of("p", "3", "inventory")).select("node_id", "sap_key")


@_query(f"""{_HYBRID} SELECT 'Domain: inventory' || chr(10) || 'Query: build' || chr(10) || 'Candidates:' || chr(10) || string_agg('- ' || label || '#' || node_id || ' key=' || sap_key || ' path=', chr(10) ORDER BY node_id) || chr(10) || 'Pointer context:' || chr(10) || '- none' AS prompt FROM m""")
def rag_prompt(spark, folder):
    lines = _hybrid(spark, folder).withColumn("line", retrieve.candidate_line()).orderBy("node_id").select("line").collect()  # at most 71
    return spark.createDataFrame([(retrieve.prompt("build", "inventory", [r[0] for r in lines], []),)], "prompt string")


@_query("WITH c AS (SELECT c_custkey * 8 node_id, r_name, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(c_mktsegment), 'build') ORDER BY 1 LIMIT 51) SELECT '- finance: ' || r_name || ' > ' || n_name || ' > ' || c_name || ' :: ' AS line FROM c")
def rag_fragments(spark, folder):
    """Pointer paths of the customers found, as prompt lines."""
    found = retrieve.search(_catalog_vertices(spark, folder).where("properties['label'] = 'Customer'"), "build", domain="finance")
    return retrieve.resolve(found, _paths(spark, folder)).select(retrieve.fragment_line().alias("line"))


_PLACE = "CASE WHEN substr(md5(w), 9, 1) < '8' THEN -1 ELSE 1 END sign, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 place"


@_query(f"""WITH t AS (SELECT DISTINCT text FROM entity_embeddings WHERE text IS NOT NULL UNION SELECT 'valve seat'),
w AS (SELECT text, {_PLACE} FROM (SELECT text, unnest(regexp_split_to_array(lower(text), '\\s+')) w FROM t) WHERE w <> ''),
s AS (SELECT text, place, sum(sign)::DOUBLE x FROM w GROUP BY ALL), n AS (SELECT text, sqrt(sum(x * x)) norm FROM s GROUP BY 1),
v AS (SELECT s.text, place, coalesce((x / nullif(norm, 0))::FLOAT, 0)::DOUBLE x FROM s JOIN n USING (text)), q AS (SELECT place, x FROM v WHERE text = 'valve seat'), qq AS (SELECT sum(x * x) d FROM q),
d AS (SELECT v.text, sum(v.x * v.x) - 2 * sum(v.x * coalesce(q.x, 0)) + any_value(qq.d) d FROM v CROSS JOIN qq LEFT JOIN q ON q.place = v.place GROUP BY 1)
SELECT DISTINCT node_id, round(CASE WHEN e.text IS NULL THEN NULL ELSE abs(coalesce(d.d, qq.d)) END, 3) distance FROM entity_embeddings e CROSS JOIN qq LEFT JOIN d ON d.text = e.text""")
def rag_embed(spark, folder):
    """Hashed embeddings of all entity texts and their distance to a question's."""
    embed = hashed_embedding()
    rows = table(spark, folder, "entity_embeddings").select("node_id", "text").distinct().withColumn("vector", embed("text"))
    query = spark.createDataFrame([("valve seat",)], "text string").select(embed("text")).first()[0]
    return rows.select("node_id", F.round(squared_l2("vector", query), 3).alias("distance")).distinct()


# --- profiling --------------------------------------------------------------------------------------------------------------------------

_PROFILED = ["region", "nation", "customer", "supplier", "orders", "lineitem", "part"]
_UNIQUE_SQL = " UNION ALL ".join(f"SELECT '{t}' table_name, '{c}' column_name, count({c}) non_null, count({c}) > 0 AND count({c}) = count(DISTINCT {c}) is_unique FROM {t}" for t in _PROFILED for c in _T[t])


@_query(_UNIQUE_SQL)
def profile_unique(spark, folder):
    return profile.as_frame(spark, profile.profile({t: table(spark, folder, t) for t in _PROFILED}))


_PAIR = "source_table string, source_column string, target_table string, target_column string"
_WHOLE = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"]}


def _fk_sql(columns: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' source_table, '{c}' source_column, '{t}' target_table, '{u}' target_column WHERE (SELECT count({c}) FROM {s}) > 0 AND (SELECT count({u}) = count(DISTINCT {u}) AND count({u}) > 0 FROM {t}) AND NOT EXISTS (SELECT 1 FROM {s} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {u} FROM {t} WHERE {u} IS NOT NULL))"
        for s in columns for c in columns[s] for t in columns for u in columns[t] if s != t
    )


@_query(_fk_sql(_WHOLE))
def profile_fk(spark, folder):
    """Inclusion dependencies among the columns of _WHOLE, a selection; profile_fk_all has those of all tables."""
    tables = {t: table(spark, folder, t).select(*c) for t, c in _WHOLE.items()}
    return spark.createDataFrame(profile.inclusions(tables, profile.profile(tables)), _PAIR)


#: The whole-number columns of all profiled tables, written out for the SQL only.
_ALL_WHOLE = _WHOLE | {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "part": ["p_partkey", "p_size"]}


@_query(_fk_sql(_ALL_WHOLE))
def profile_fk_all(spark, folder):
    """Inclusion dependencies among the whole-number columns of all profiled tables, which are taken from their schemas."""
    tables = {t: table(spark, folder, t) for t in _PROFILED}
    return spark.createDataFrame(profile.inclusions(tables, profile.profile(tables, ["whole"])), _PAIR)


@_query("SELECT * FROM (VALUES ('NODE Nation FROM nation WITH id = n_nationkey'), ('NODE Region FROM region WITH id = r_regionkey'), ('EDGE RefersTo_region FROM nation USING n_nationkey -> n_regionkey')) t(statement)")
def profile_dsl(spark, folder):
    """The draft mapping of three columns and one inclusion, a selection; profile_dsl_all has that of all tables."""
    tables = {"region": table(spark, folder, "region").select("r_regionkey"), "nation": table(spark, folder, "nation").select("n_nationkey", "n_regionkey")}
    found = profile.profile(tables)
    pairs = [p for p in profile.inclusions(tables, found) if p[0] == "nation" and p[1] == "n_regionkey"]
    return spark.createDataFrame([(x,) for x in profile.draft_mapping(found, pairs).text().split("\n")], "statement string")


#: All columns of the profiled tables by type family, written out for the SQL only.
_KINDS = {"whole": _ALL_WHOLE, "time": {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}, "number": {"customer": ["c_acctbal"], "supplier": ["s_acctbal"], "orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_retailprice"]}}
_KINDS["text"] = {t: [c for c in _T[t] if not any(c in k.get(t, []) for k in _KINDS.values())] for t in _PROFILED}
_ORDER = ", ".join(f"('{t}', '{c}', {i})" for t in _PROFILED for i, c in enumerate(_T[t]))
_NODES = ", ".join(f"('{t}', {i})" for i, t in enumerate(_PROFILED))


@_query(f"""WITH u AS ({_UNIQUE_SQL}), fk AS ({" UNION ALL ".join(_fk_sql(k) for k in _KINDS.values())}),
ids AS (SELECT n.t, coalesce((SELECT o.c FROM (VALUES {_ORDER}) o(t, c, i) JOIN u ON u.table_name = o.t AND u.column_name = o.c WHERE o.t = n.t AND u.is_unique
  ORDER BY NOT (contains(o.t, o.c) OR contains(o.c, o.t) OR contains(o.c, 'id')), o.i LIMIT 1), 'UNKNOWN_ID') id FROM (VALUES {_NODES}) n(t, i)),
e AS (SELECT *, row_number() OVER (PARTITION BY target_table ORDER BY source_table, source_column, target_column) k FROM fk)
SELECT 'NODE ' || upper(t[1]) || t[2:] || ' FROM ' || t || ' WITH id = ' || id AS statement FROM ids
UNION ALL SELECT DISTINCT 'EDGE RefersTo_' || target_table || CASE WHEN k > 1 THEN '_' || source_table || '_' || source_column ELSE '' END || ' FROM ' || source_table || ' USING ' || id || ' -> ' || source_column FROM e JOIN ids ON t = source_table""")
def profile_dsl_all(spark, folder):
    """The draft mapping of all profiled tables: a node for each, an edge for each inclusion among their columns of one type family."""
    tables = {t: table(spark, folder, t) for t in _PROFILED}
    found = profile.profile(tables)
    return spark.createDataFrame([(x,) for x in profile.draft_mapping(found, profile.inclusions(tables, found)).text().split("\n")], "statement string")
