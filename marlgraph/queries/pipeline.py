"""Queries p2 to p7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.functions.canonical import canonical_key, canonical_table
from marlgraph.operators import change_feed, heavy_keys, incremental, orphans, wide
from marlgraph.runtime import materialize, scratch_path
from marlgraph.sources.tables import table
from marlgraph.streaming import dedupe

MESSAGE = ["src_table", "primary_key", "lsn"]


def _feed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"src_table": canonical_table("src_table"), "primary_key": canonical_key("primary_key")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = change_feed.apply_changes(_feed(table(spark, folder, "cdc_events")), ["src_table", "primary_key"], "lsn", "operation")
    return rows.select("src_table", "primary_key", F.col("_seq").alias("lsn"))


def p2_two_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """The same table from two feeds, of which the later half of the batches comes first; every message is in one of them."""
    feed, root = _feed(table(spark, folder, "cdc_events")), scratch_path(spark, "two_feeds")
    middle = feed.agg(F.percentile_approx("batch_id", 0.5)).first()[0]
    late = F.coalesce(F.col("batch_id") > middle, F.lit(False))
    for part in (feed.where(late), feed.where(~late)):
        rows = change_feed.apply_changes(part, ["src_table", "primary_key"], "lsn", "operation", publish_to=root)
    return rows.select("src_table", "primary_key", F.col("_seq").alias("lsn"))


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The present rows with the number of fields of their image and its total of whole numbers (null without an image)."""
    feed = _feed(table(spark, folder, "cdc_events"))
    kind = feed.schema["after_image"].dataType
    rows = change_feed.apply_changes(feed, ["src_table", "primary_key"], "lsn", "operation", F.to_json("after_image", {"ignoreNullFields": "false"}))
    image = F.from_json("_payload", T.StructType([T.StructField("m", kind)])["m"].dataType)
    total = F.aggregate(F.map_values("image"), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v["int_value"], F.lit(0)))
    return rows.withColumn("image", image).select("src_table", "primary_key", F.col("_seq").alias("lsn"), F.when(F.col("image").isNotNull(), F.size("image")).cast("long").alias("fields"), total.alias("whole_numbers"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys.heavy_sources(table(spark, folder, "edge_writes"), table(spark, folder, "adjacency_runs")).select("tenant_id", "source_id")


def p3_degree(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys.degrees(table(spark, folder, "edge_writes"), table(spark, folder, "adjacency_runs"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    pairs = heavy_keys.edge_pairs(table(spark, folder, "edge_writes"), table(spark, folder, "adjacency_runs"))
    rows = heavy_keys.neighbour_segments(pairs)
    return rows.select("tenant_id", "source_id", "segment", F.array_join("neighbours", ",").alias("neighbours"))


def _loads(spark: SparkSession, folder: str) -> DataFrame:
    """The output of the second of two loads: the first took the copies that succeeded runs had read, the second takes what is new or changed against it in the whole feed."""
    feed = _feed(table(spark, folder, "cdc_events")).where("src_table IS NOT NULL AND primary_key IS NOT NULL AND lsn IS NOT NULL")
    image = [F.col("operation"), incremental.hashable("before_image"), incremental.hashable("after_image")]
    copies = materialize(feed.select(*MESSAGE, incremental.content_hash(*image).alias("content"), F.col("ingested_at").alias("arrived")), "copies")
    log = table(spark, folder, "run_log").where(F.lower(F.trim("status")) == "succeeded")
    runs = log.select(canonical_table("src_table").alias("src_table"), F.col("from_lsn").alias("from_seq"), F.col("to_lsn").alias("to_seq"), "read_until")
    load = incremental.IncrementalLoad(spark, None, MESSAGE)
    load.run(incremental.covered(copies, runs, "src_table", "lsn", "arrived"), ["content"])
    return load.run(copies, ["content"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that the second load finds new. One that an earlier run had processed and of which a later copy holds something else is changed, not new; p4_changes has both."""
    return _loads(spark, folder).where("change = 'new'").select(*MESSAGE).distinct()


def p4_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Messages per table that the second load finds new or changed."""
    return _loads(spark, folder).groupBy("src_table", "change").agg(F.count_distinct("primary_key", "lsn").alias("messages"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(table(spark, folder, "edge_writes"), table(spark, folder, "vertex_writes")).select("request_id", "endpoint", "kind").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphans(table(spark, folder, "edge_writes"), table(spark, folder, "vertex_writes")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide.filled_cells(wide.wide(table(spark, folder, "vertex_attributes"), table(spark, folder, "attribute_catalog")))


def p6_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide rows; the unreadable cells as one string, sorted by name."""
    rows = wide.wide(table(spark, folder, "vertex_attributes"), table(spark, folder, "attribute_catalog"))
    failed = F.array_join(F.transform(F.array_sort(F.map_entries("failed")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.withColumn("failed", failed)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    # the star makes it a pattern, which a stream source needs where the table is a single file
    path = f"{folder}/cdc_events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(path + "*")
    root = scratch_path(spark, "deduplicated")
    query = dedupe.deduplicate(_feed(stream), MESSAGE, "ingested_at", root)
    query.awaitTermination()
    return _repeated(spark, root).select(*MESSAGE)


def p7_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated messages with the number of copies dropped, from the table delivered in six micro-batches over restarts; days lie between them, so identifiers expire and are looked up."""
    rows, root = _feed(table(spark, folder, "cdc_events")), scratch_path(spark, "delivered")
    borders = rows.agg(F.percentile_approx("batch_id", [k / 6 for k in range(1, 6)])).first()[0] or []
    piece = sum((F.coalesce(F.col("batch_id") > b, F.lit(False)).cast("int") for b in borders), F.lit(0))
    rows = materialize(rows.select(*MESSAGE, "ingested_at", piece.alias("piece")), "pieces")
    for k in range(len(borders) + 1):
        rows.where(F.col("piece") == k).select(*MESSAGE, "ingested_at").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.drop("piece").schema).parquet(f"{root}/in")
        dedupe.deduplicate(stream, MESSAGE, "ingested_at", f"{root}/out").awaitTermination()
    return _repeated(spark, f"{root}/out")


def _repeated(spark: SparkSession, root: str) -> DataFrame:
    rows = dedupe.repeated(spark, root, MESSAGE)
    return rows if rows is not None else spark.createDataFrame([], "src_table string, primary_key string, lsn long, dropped long")


QUERIES = {f.__name__: f for f in (p2_found, p2_two_feeds, p2_rows, p3_found, p3_degree, p3_neighbours, p4_found, p4_changes, p5_found, p5_report, p6_found, p6_wide, p7_found, p7_batches)}

_FEED = r"""feed AS (SELECT upper(trim(src_table)) src_table, regexp_replace(upper(trim(primary_key)), '(^|\|)0+([^|])', '\1\2', 'g') primary_key, lsn, operation, after_image, ingested_at FROM cdc_events)"""
_ENTRIES = "list_sort(list_transform(map_keys({0}), lambda k: k || '=' || coalesce({0}[k]::VARCHAR, '')))::VARCHAR"
_CONTENT = f"concat_ws('~', coalesce(operation::VARCHAR, ''), coalesce({_ENTRIES.format('before_image')}, 'none'), coalesce({_ENTRIES.format('after_image')}, 'none'))"
_TENANT = "CASE WHEN tenant_id IS NULL OR tenant_id = '' THEN 'default' ELSE tenant_id END"
_OCCUR = f"""occ AS (SELECT {_TENANT} tenant_id, source_id, 1::BIGINT n FROM edge_writes WHERE source_id IS NOT NULL
  UNION ALL SELECT {_TENANT}, node_id, len(out_edges)::BIGINT FROM adjacency_runs WHERE node_id IS NOT NULL AND len(out_edges) > 0)"""
_PAIRS = f"""pairs AS (SELECT {_TENANT} tenant_id, source_id, target_id FROM edge_writes WHERE source_id IS NOT NULL AND target_id IS NOT NULL
  UNION SELECT {_TENANT}, node_id, unnest(out_edges) FROM adjacency_runs WHERE node_id IS NOT NULL)"""
_ORPHANS = f"""
v AS (SELECT {_TENANT} tenant_id, node_id, written_at, write_id, coalesce(upper(trim(op)), 'PUT') = 'DELETE' removed FROM vertex_writes WHERE node_id IS NOT NULL),
f AS (SELECT tenant_id, node_id, min(written_at) first_at, bool_or(removed) ever FROM v GROUP BY ALL),
e AS (SELECT request_id, {_TENANT} tenant_id, requested_at, source_id, target_id FROM edge_writes WHERE coalesce(upper(trim(op)), 'PUT') = 'PUT'),
r AS (SELECT DISTINCT * FROM (SELECT request_id, 'source' endpoint, tenant_id, source_id node_id, requested_at FROM e UNION ALL SELECT request_id, 'target', tenant_id, target_id, requested_at FROM e) WHERE node_id IS NOT NULL),
w AS (SELECT r.request_id, r.endpoint, r.requested_at, arg_max(v.removed, (v.written_at, v.write_id)) gone FROM r JOIN f USING (tenant_id, node_id) JOIN v USING (tenant_id, node_id)
  WHERE f.ever AND v.written_at <= r.requested_at GROUP BY ALL),
o AS (SELECT request_id, endpoint, requested_at, CASE WHEN f.node_id IS NULL THEN 'missing' ELSE 'late' END kind FROM r LEFT JOIN f USING (tenant_id, node_id) WHERE f.node_id IS NULL OR first_at > requested_at
  UNION SELECT request_id, endpoint, requested_at, 'deleted' FROM w WHERE gone)"""
_NUM = r"(\d+|\d{1,3}(,\d{3})+)"
_FRAC = r"(\d+|\d{1,3}(,\d{3})+)(\.\d*)?|\.\d+"


def _typed(name: str, kind: str) -> str:
    v = rf"regexp_replace(max(value) FILTER (attr = '{name}'), '^\s+|\s+$', '', 'g')"
    sign = f"(CASE WHEN contains({v}, '-') THEN '-' ELSE '' END || regexp_replace({v}, '[,+-]', '', 'g'))"
    if kind == "string":
        return f"CASE WHEN {v} <> '' THEN max(value) FILTER (attr = '{name}') END"
    if kind == "long":
        return f"CASE WHEN regexp_matches({v}, '^([+-]?({_NUM})|({_NUM})-)$') THEN try_cast({sign} AS BIGINT) END"
    if kind == "double":
        return f"CASE WHEN regexp_matches({v}, '^([+-]?({_FRAC})|({_FRAC})-)$') THEN try_cast({sign} AS DOUBLE) END"
    if kind == "boolean":
        return f"CASE WHEN lower({v}) IN ('true','yes','y','x','1') THEN true WHEN lower({v}) IN ('false','no','n','0') THEN false END"
    return rf"""coalesce(CASE WHEN regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_strptime({v}, '%Y-%m-%d')::DATE END, CASE WHEN regexp_matches({v}, '^\d{{8}}$') THEN try_strptime({v}, '%Y%m%d')::DATE END,
      CASE WHEN regexp_matches({v}, '^\d{{2}}\.\d{{2}}\.\d{{4}}$') THEN try_strptime({v}, '%d.%m.%Y')::DATE END)"""


#: The declared attributes of attribute_catalog. Fixed values, for the SQL only; the operator reads the catalog.
ATTRIBUTES = {"brgew": "double", "country": "string", "ebelp": "long", "erdat": "date", "is_active": "boolean", "label": "string", "lead_days": "long", "lvorm": "boolean", "maktx": "string", "menge": "long", "mtart": "string", "netpr": "double", "plant": "string", "rating": "long", "tolerance": "double", "valid_to": "date"}


def _wide_sql(last: str) -> str:
    columns = ",\n  ".join(f"{_typed(n, k)} {n}" for n, k in ATTRIBUTES.items())
    return rf"""WITH names AS (SELECT attr_name, regexp_replace(lower(unnest(list_append(coalesce(alt_names, []), attr_name))), '[\s_-]', '', 'g') plain FROM attribute_catalog),
rows AS (SELECT {_TENANT} tenant_id, node_id, names.attr_name attr, attr_value, coalesce(write_seq, -1) s FROM vertex_attributes a JOIN names ON regexp_replace(lower(a.attr_name), '[\s_-]', '', 'g') = plain WHERE node_id IS NOT NULL),
cells AS (SELECT tenant_id, node_id, attr, max(attr_value) AS value FROM rows JOIN (SELECT tenant_id, node_id, attr, max(s) s FROM rows GROUP BY ALL) USING (tenant_id, node_id, attr, s) GROUP BY ALL),
wide AS (SELECT tenant_id, node_id, {columns} FROM cells GROUP BY tenant_id, node_id)
{last}"""


def _failed_sql() -> str:
    unread = " OR ".join(f"(attr = '{n}' AND {n} IS NULL)" for n in ATTRIBUTES)
    return _wide_sql(rf"""SELECT wide.*, coalesce(failed, '') failed FROM wide LEFT JOIN (SELECT tenant_id, node_id, string_agg(attr || '=' || value, ';' ORDER BY attr) failed FROM cells JOIN wide USING (tenant_id, node_id)
  WHERE regexp_matches(value, '\S') AND ({unread}) GROUP BY ALL) USING (tenant_id, node_id)""")


def sql() -> dict[str, str]:
    filled = "\nUNION ALL ".join(f"SELECT tenant_id, node_id, '{n}' attr_name FROM wide WHERE {n} IS NOT NULL" for n in ATTRIBUTES)
    last = "SELECT src_table, primary_key, max(lsn) lsn{} FROM feed WHERE operation IN (1, 2, 3) GROUP BY src_table, primary_key HAVING arg_max(operation, lsn) <> 3"
    return {
        "p2_found": f"WITH {_FEED} " + last.format(""),
        "p2_two_feeds": f"WITH {_FEED} " + last.format(""),
        "p2_rows": f"WITH {_FEED}, n AS (SELECT * , len(map_keys(after_image))::BIGINT fields, list_sum(list_transform(map_values(after_image), lambda v: coalesce(v.int_value, 0)))::BIGINT whole FROM feed), l AS ("
        + last.format("").replace("FROM feed", "FROM n")
        + ") SELECT DISTINCT l.*, n.fields, CASE WHEN n.fields IS NOT NULL THEN coalesce(n.whole, 0) END whole_numbers FROM l JOIN n USING (src_table, primary_key, lsn)",
        "p3_found": f"WITH {_OCCUR} SELECT tenant_id, source_id FROM occ GROUP BY ALL HAVING sum(n) * 100 >= (SELECT sum(n) FROM occ)",
        "p3_degree": f"WITH {_OCCUR}, {_PAIRS} SELECT tenant_id, source_id, sum(n)::BIGINT degree, coalesce(any_value(k), 0)::BIGINT neighbours FROM occ LEFT JOIN (SELECT tenant_id, source_id, count(*) k FROM pairs WHERE target_id IS NOT NULL GROUP BY ALL) USING (tenant_id, source_id) GROUP BY ALL",
        "p3_neighbours": f"WITH {_PAIRS}, p AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY target_id) - 1) // 1000 segment FROM pairs WHERE target_id IS NOT NULL) SELECT tenant_id, source_id, segment::BIGINT segment, string_agg(target_id::VARCHAR, ',' ORDER BY target_id) neighbours FROM p GROUP BY tenant_id, source_id, segment",
        "p4_found": f"WITH {_FEED}, m AS (SELECT src_table, primary_key, lsn, min(ingested_at) arrived FROM feed GROUP BY ALL), r AS (SELECT upper(trim(src_table)) t, from_lsn, to_lsn, read_until FROM run_log WHERE lower(trim(status)) = 'succeeded') SELECT * EXCLUDE (arrived) FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.t = m.src_table AND from_lsn < lsn AND lsn <= to_lsn AND arrived <= read_until)",
        "p4_changes": f"""WITH {_FEED}, r AS (SELECT upper(trim(src_table)) t, from_lsn, to_lsn, read_until FROM run_log WHERE lower(trim(status)) = 'succeeded'),
c AS (SELECT src_table, primary_key, lsn, {_CONTENT} content, min(ingested_at) arrived FROM (SELECT upper(trim(src_table)) src_table, regexp_replace(upper(trim(primary_key)), '(^|\\|)0+([^|])', '\\1\\2', 'g') primary_key, lsn, operation, before_image, after_image, ingested_at FROM cdc_events) GROUP BY ALL),
m AS (SELECT c.*, EXISTS (SELECT 1 FROM r WHERE r.t = c.src_table AND from_lsn < lsn AND lsn <= to_lsn AND arrived <= read_until) seen FROM c),
k AS (SELECT src_table, primary_key, lsn, CASE WHEN NOT bool_or(seen) THEN 'new' WHEN count(DISTINCT content) <> count(DISTINCT content) FILTER (seen) THEN 'changed' END change FROM m GROUP BY ALL)
SELECT src_table, change, count(*) messages FROM k WHERE change IS NOT NULL AND src_table IS NOT NULL AND primary_key IS NOT NULL AND lsn IS NOT NULL GROUP BY ALL""",
        "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT request_id, endpoint, kind FROM o",
        "p5_report": f"WITH {_ORPHANS} SELECT endpoint, kind, strftime(requested_at, '%Y-%m') \"month\", count(*) orphans, count(DISTINCT request_id) requests FROM (SELECT DISTINCT * FROM o) GROUP BY ALL",
        "p6_found": _wide_sql(filled),
        "p6_wide": _failed_sql(),
        "p7_found": f"WITH {_FEED} SELECT src_table, primary_key, lsn FROM feed GROUP BY ALL HAVING count(*) >= 2",
        "p7_batches": f"WITH {_FEED} SELECT src_table, primary_key, lsn, count(*) - 1 dropped FROM feed WHERE src_table IS NOT NULL AND primary_key IS NOT NULL AND lsn IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    }
