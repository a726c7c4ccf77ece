"""One object with the verbs of the graph: queries, reads, writes, traversal, search and ingestion, for one tenant and principal."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgraph.functions.canonical import canonical_tenant
from marlgraph.operators import profile, retrieve, store, traverse
from marlgraph.operators.retrieve import Policy, Principal
from marlgraph.plans import executor, pattern, planner
from marlgraph.plans.catalog import LABELS, Catalog
from marlgraph.runtime import BucketedTable, VersionedTable, materialize
from marlgraph.sources.events import graph_writes

LOG = logging.getLogger("marlgraph.audit")
MAX_ID = (1 << 63) - 1
VERTEX_LOG = "tenant_id string, node_id long, properties map<string,string>, op string, seq long"
EDGE_LOG = "tenant_id string, src long, dst long, properties map<string,string>, op string, seq long"
PATH_LOG = "tenant_id string, node_id long, path array<string>, sap_key string, op string, seq long"
#: Every log also says where a write comes from, when it was written (nanoseconds) and, once compacted, for how many puts a row stands.
LOGS = {name: f"{schema}, source string, written long, puts long" for name, schema in {"vertices": VERTEX_LOG, "edges": EDGE_LOG, "paths": PATH_LOG}.items()}
#: Sources of writes that don't come from a table's events: single ones, whose sequence is the clock, and frames with a sequence of their own.
MANUAL, FRAME = "", "*"


class NotFound(LookupError):
    """No such vertex."""


class GraphSession:
    """root: folder of the logs. Rows are appended; views take the latest of each key, so writers never wait for each other.

    Single writes are small files; `ingest` and `put_*_frame` write in bulk, and `compact` folds a log's files into buckets without changing any answer.
    Sequences of different sources aren't compared: of each source its last write counts, and of these the one written last.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None, tables: Callable[[str], DataFrame] | None = None, tenant_id: str = "default", principal: Principal | None = None, allowed_labels: frozenset[str] = frozenset(), policy: Policy | None = None, unique_ids: frozenset[str] = frozenset(), embeddings: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), catalog or Catalog()
        self.tables = tables or spark.table
        self.tenant_id, self.principal, self.policy = tenant_id, principal or Principal("anonymous"), policy or Policy()
        self.context, self.unique_ids = planner.SecurityContext(tenant_id, frozenset(allowed_labels)), unique_ids
        self.embeddings, self.embed, self.metrics = embeddings, embed, retrieve.Metrics()
        if self.principal.name == "anonymous" and tenant_id == "admin":
            LOG.warning("denied: %s on tenant %s", self.principal.name, tenant_id)
            raise PermissionError("anonymous may not use the tenant admin")

    # --- patterns ---------------------------------------------------------------------------------------------------------------------

    def query(self, text: str, limit: int = 0, extended: bool = False, declared: bool = False, strict: bool = False) -> DataFrame:
        """Matches of a pattern. declared: variables have their key columns and declared properties only; strict: no conversion between text and numbers."""
        LOG.info("query by %s on %s: %s", self.principal.name, self.tenant_id, text)
        plan = planner.build(pattern.parse(text, extended), self.catalog, self.context, self.unique_ids, limit)
        return executor.execute(plan, self.tables, declared, strict)

    def list_schema(self) -> DataFrame:
        return self.catalog.as_frame(self.spark)

    # --- logs -------------------------------------------------------------------------------------------------------------------------

    def _table(self, name: str) -> BucketedTable:
        keys, _ = store.VALUES[name]
        return BucketedTable(self.spark, f"{self.root}/compacted-{name}", [*keys, "source"])

    def _files(self, name: str, folded: list[str]) -> list[str]:
        """Names of the log's files that aren't folded."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(set(n for n in names if n.endswith(".parquet") and n[0] not in "._") - set(folded))

    def _appended(self, name: str, files: list[str]) -> DataFrame:
        return self.spark.read.schema(LOGS[name]).parquet(*[f"{self.root}/{name}/{f}" for f in files]) if files else self.spark.createDataFrame([], LOGS[name])

    def _log(self, name: str) -> DataFrame:
        """The compacted buckets and the files appended since."""
        table = self._table(name)
        said = table.content()
        rows = self._appended(name, self._files(name, said.get("folded", [])))
        base = table.read_buckets(said)
        return rows if base is None else rows.unionByName(base.drop("_bucket"))

    def _append(self, name: str, rows: DataFrame) -> None:
        self.policy.check_write(self.principal)
        given = {f.name: f.dataType for f in rows.schema.fields}
        known = {"source": F.lit(MANUAL), "written": F.lit(time.time_ns()), "op": F.lit("PUT")}
        columns = [(F.col(c) if c in given else known.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in (f.split(" ", 1) for f in LOGS[name].split(", "))]
        rows.select(columns).write.mode("append").parquet(f"{self.root}/{name}")

    def _one(self, name: str, schema: str, row: tuple) -> None:
        self._append(name, self.spark.createDataFrame([row], schema))

    @staticmethod
    def _id(value: int) -> int:
        if not 0 <= value <= MAX_ID:
            raise ValueError(f"id out of range: {value}")
        return value

    @property
    def vertices(self) -> DataFrame:
        return store.latest_vertices(self._log("vertices"))

    @property
    def edges(self) -> DataFrame:
        return store.latest_edges(self._log("edges"))

    @property
    def paths(self) -> DataFrame:
        return store.latest_pointer_paths(self._log("paths"))

    # --- writes -----------------------------------------------------------------------------------------------------------------------

    def put_vertex(self, node_id: int, properties: dict[str, str]) -> None:
        self._one("vertices", VERTEX_LOG, (self.tenant_id, self._id(node_id), properties, "PUT", time.time_ns()))

    def delete_vertex(self, node_id: int) -> None:
        self._one("vertices", VERTEX_LOG, (self.tenant_id, self._id(node_id), None, "DELETE", time.time_ns()))

    def put_edge(self, src: int, dst: int, properties: dict[str, str] | None = None) -> None:
        self._one("edges", EDGE_LOG, (self.tenant_id, self._id(src), self._id(dst), properties or {}, "PUT", time.time_ns()))

    def delete_edge(self, src: int, dst: int) -> None:
        self._one("edges", EDGE_LOG, (self.tenant_id, self._id(src), self._id(dst), None, "DELETE", time.time_ns()))

    def put_pointer_path(self, node_id: int, path: list[str], sap_key: str) -> None:
        self._one("paths", PATH_LOG, (self.tenant_id, self._id(node_id), path, sap_key, "PUT", time.time_ns()))

    def put_vertices_frame(self, rows: DataFrame) -> None:
        """Columns node_id, properties and optionally seq."""
        self._append("vertices", self._bulk(rows, ["node_id", "properties"]))

    def put_edges_frame(self, rows: DataFrame) -> None:
        """Columns src, dst, properties and optionally seq."""
        self._append("edges", self._bulk(rows, ["src", "dst", "properties"]))

    def put_log(self, name: str, rows: DataFrame) -> None:
        """Appends rows of a log as they are, for instance of a restored one, whatever their tenants."""
        self._append(name, rows if "source" in rows.columns else rows.withColumn("source", F.lit(FRAME)))

    def _bulk(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        own = "seq" in rows.columns
        seq = F.col("seq").cast("long") if own else F.lit(time.time_ns())
        return rows.select(F.lit(self.tenant_id).alias("tenant_id"), *columns, F.lit("PUT").alias("op"), seq.alias("seq"), F.lit(FRAME if own else MANUAL).alias("source"))

    def label_codes(self) -> dict[str, int]:
        """Codes of the catalog's labels in this graph's ids. A label keeps its code for good; new ones get the next."""
        table = VersionedTable(self.spark, f"{self.root}/labels")
        number = table.head()
        said = table.content(number)
        codes = said.get("codes", {})
        fresh = [label for label in self.catalog.nodes if label not in codes]
        if fresh:
            codes = codes | {label: len(codes) + i for i, label in enumerate(fresh)}
            if len(codes) >= LABELS:
                raise ValueError(f"a graph has room for {LABELS - 1} labels")
            table.publish({"codes": codes}, number)
        return codes

    def vertex_id(self, label: str, key: int) -> int:
        """The id of the vertex that events of the label's table write for a key."""
        return self._id(key) * LABELS + self.label_codes()[label]

    def ingest(self, events: DataFrame) -> None:
        """Events, batch or a micro-batch, become vertices and edges by the catalog, under the ids of `vertex_id`. Repeats change nothing: the latest lsn of a key in its table decides."""
        vertices, edges = graph_writes(events, self.catalog, self.tenant_id, self.label_codes(), LABELS)
        if vertices is not None:
            self._append("vertices", vertices)
        if edges is not None:
            self._append("edges", edges)

    def compact(self, name: str) -> None:
        """Folds the files of vertices, edges or paths that are there when it begins into buckets by key; only buckets that they touch are rewritten.

        Nothing changes for readers: one commit names the new buckets and the folded files together, files appended meanwhile stay, and tombstones and
        numbers of puts are kept. Files folded by the compaction before are deleted now, when no reader of that time is left.
        """
        self.policy.check_write(self.principal)
        table, (keys, values) = self._table(name), store.VALUES[name]
        number = table.head()
        said = table.content(number)
        files = self._files(name, said.get("folded", []))
        if not files:
            return
        rows = materialize(store.compacted(self._appended(name, files), keys, values), "compacting")
        n = table.buckets_for(said, rows.count())
        bucket = table.bucket(n)
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()} if said.get("buckets") == n else None  # at most n
        base = table.read_buckets(said, touched)
        if base is not None:
            rows = store.compacted(rows.unionByName(base.drop("_bucket")), keys, values)
        rows = rows.withColumn("_bucket", bucket).repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", *keys)
        parts, schema = table.stage_buckets(rows)
        table.publish(table.merged(said, n, touched, parts, schema, folded=files), number)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for f in said.get("folded", []):
            fs.delete(path(f"{self.root}/{name}/{f}"), False)

    def telemetry(self) -> DataFrame:
        """(log, compactions, buckets, compacted_rows, appended_files, bytes) of each log."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        size = lambda name: fs.getContentSummary(path(f"{self.root}/{name}")).getLength() if fs.exists(path(f"{self.root}/{name}")) else 0
        rows = []
        for name in LOGS:
            table = self._table(name)
            said = table.content()
            parts = said.get("parts", {}).values()
            rows.append((name, table.head(), len(parts), sum(n for _, n in parts), len(self._files(name, said.get("folded", []))), size(name) + size(f"compacted-{name}")))
        return self.spark.createDataFrame(rows, "log string, compactions long, buckets long, compacted_rows long, appended_files long, bytes long")

    # --- reads ------------------------------------------------------------------------------------------------------------------------

    def get_vertex(self, node_id: int) -> dict[str, str]:
        row = store.get_vertex(self.vertices, self.tenant_id, self._id(node_id)).first()
        if row is None:
            raise NotFound(node_id)
        return row["properties"]

    def get_edge(self, src: int, dst: int) -> DataFrame:
        return store.get_edge(self.edges, self.tenant_id, src, dst)

    def scan_vertices(self) -> DataFrame:
        return store.scan_vertices(self.vertices, self.tenant_id)

    def neighbours(self, ids: int | DataFrame) -> DataFrame:
        """(node_id, segment, out_edges, in_edges) of the ids asked for; unknown ones have empty lists. Only a hub has more than segment 0."""
        edges = self.edges.where(F.col("tenant_id") == self.tenant_id)
        if isinstance(ids, int):
            # a literal condition on the log's keys, which reaches its scan
            edges = edges.where((F.col("src") == self._id(ids)) | (F.col("dst") == ids))
        asked = self.spark.createDataFrame([(ids,)], "node_id long") if isinstance(ids, int) else ids.select("node_id").distinct()
        found = store.both_ends(edges).join(asked, "node_id", "left_semi")
        return traverse.with_lists(asked, store.neighbour_lists(found, ["node_id"]))

    def degree(self, ids: DataFrame) -> DataFrame:
        return store.degrees(self._log("edges").where(canonical_tenant("tenant_id") == self.tenant_id)).join(ids.select("node_id").distinct(), "node_id", "right").select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "out_degree", "in_degree")])

    def expand_neighborhood(self, anchor: int, max_depth: int, max_nodes_visited: int | None = None, direction: str = "Outbound") -> DataFrame:
        edges = materialize(self.edges.where(F.col("tenant_id") == self.tenant_id), "edges")
        visited = traverse.expand(edges, self._id(anchor), max_depth, max_nodes_visited, direction, self.tenant_id)
        return traverse.with_neighbours(visited, edges, direction, self.tenant_id)

    def pointer_paths(self, prefix: list[str]) -> DataFrame:
        return store.pointer_paths(self.paths, self.tenant_id, prefix)

    # --- retrieval --------------------------------------------------------------------------------------------------------------------

    def search(self, domain: str | None, text: str) -> DataFrame:
        return retrieve.search(self.vertices, text, self.tenant_id, domain)

    def recall(self, domain: str | None, vector: list[float], k: int = retrieve.RECALL) -> DataFrame:
        if self.embeddings is None:
            raise ValueError("no embeddings are configured")
        return retrieve.recall(self.embeddings, vector, domain, k)

    def answer(self, question: str, enable_embeddings: bool = False, llm: Callable[[str], str] | None = None, max_fragments: int = retrieve.FRAGMENTS) -> retrieve.RagResult:
        return retrieve.answer(question, self.principal, self.policy, self.vertices, self.paths, self.embeddings, self.embed, llm, self.tenant_id, enable_embeddings, max_fragments, self.metrics)


def profile_tables(tables: dict[str, DataFrame]) -> tuple[dict, list[tuple[str, str, str, str]], str]:
    """(column profiles, inclusion dependencies, text of a draft mapping)."""
    found = profile.profile(tables)
    pairs = profile.inclusions(tables, found)
    return found, pairs, profile.draft_mapping(found, pairs).text()
