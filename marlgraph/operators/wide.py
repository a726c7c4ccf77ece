"""Attribute-value rows reshaped into one wide row per entity with typed columns.

Spellings of attributes are resolved by a literal map of the catalog (read with a checked bound). The latest write of each cell is an algebraic
aggregate, so an entity with any number of rows shuffles one row per attribute and partition. An entity's cells then form a key-value map of at
most as many entries as the catalog has, from which the declared columns are projected; values that can't be read stay in `failed`.

Cases: null node ids are left out, null tenants are `default`; unknown attributes are left out; the highest write_seq decides, of equal ones the one
with a value and of those the greatest, and a null write_seq is lowest; a null or blank value empties the cell and isn't a failure; an
entity with only empty cells keeps its row; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgraph.functions.canonical import canonical_tenant

#: Most attributes a catalog may declare; they become columns.
MAX_ATTRIBUTES = 2_000
#: Formats. Fixed values.
LONG = r"^([+-]?(\d+|\d{1,3}(,\d{3})+)|(\d+|\d{1,3}(,\d{3})+)-)$"
DOUBLE = r"^([+-]?((\d+|\d{1,3}(,\d{3})+)(\.\d*)?|\.\d+)|((\d+|\d{1,3}(,\d{3})+)(\.\d*)?|\.\d+)-)$"
TRUE, FALSE = ["true", "yes", "y", "x", "1"], ["false", "no", "n", "0"]
DATES = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy")]


def name_key(c: Column) -> Column:
    """A name without case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def typed(value: Column, kind: str) -> Column:
    """The value as its declared type; null where it can't be read. Outer blanks are ignored."""
    v = F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    low = F.lower(v)
    if kind == "string":
        return F.when(v != "", value)
    if kind in ("long", "double"):
        digits = F.regexp_replace(v, "[,+-]", "")
        signed = F.when(v.contains("-"), F.concat(F.lit("-"), digits)).otherwise(digits)
        return F.when(v.rlike(LONG if kind == "long" else DOUBLE), signed.try_cast(kind))
    if kind == "boolean":
        return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)
    if kind == "date":
        return F.coalesce(*[F.when(v.rlike(p), F.try_to_date(v, f)) for p, f in DATES])
    raise ValueError(f"unknown data type {kind!r}")


def read_catalog(catalog: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(name, type, other names), sorted; raises beyond MAX_ATTRIBUTES, so what is sent along has a proven bound."""
    rows = catalog.where("attr_name IS NOT NULL").select("attr_name", "data_type", "alt_names").distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"the catalog declares more than {MAX_ATTRIBUTES} attributes")
    return sorted((r[0], (r[1] or "string").strip().lower(), list(r[2] or [])) for r in rows)


def wide(attributes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tenant_id, node_id, one typed column per catalog attribute, failed map<attribute, unreadable value>)."""
    declared = read_catalog(catalog)
    plain = lambda s: "".join(ch for ch in s.lower() if ch not in "-_" and not ch.isspace())
    names = {plain(other): name for name, _, others in declared for other in others if other} | {plain(name): name for name, _, _ in declared}
    if not names:
        return attributes.where("node_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "node_id").distinct().withColumn("failed", F.create_map().cast("map<string,string>"))
    lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    rows = attributes.where("node_id IS NOT NULL").select(canonical_tenant("tenant_id").alias("tenant_id"), "node_id", lookup[name_key(F.col("attr_name"))].alias("attr"), F.struct("write_seq", "attr_value").alias("w")).where("attr IS NOT NULL")
    cells = rows.groupBy("tenant_id", "node_id", "attr").agg(F.max("w").alias("w"))
    entities = cells.groupBy("tenant_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.col("w.attr_value").alias("value")))).alias("cells"))
    columns = {name: typed(F.col("cells")[name], kind) for name, kind, _ in declared}
    full = entities.select("tenant_id", "node_id", "cells", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("t"))
    blank = lambda v: v.isNull() | v.rlike(r"^[\s\u00a0]*$")
    # one test for each declared column, in generated code
    unread = [F.struct(F.lit(n).alias("key"), F.when(F.col("t")[n].isNull() & ~blank(F.col("cells")[n]), F.col("cells")[n]).alias("value")) for n in columns]
    failed = F.map_from_entries(F.filter(F.array(*unread), lambda e: e["value"].isNotNull()))
    return full.select("tenant_id", "node_id", *[F.col("t")[n].alias(n) for n in columns], failed.alias("failed"))


def filled_cells(table: DataFrame) -> DataFrame:
    """(tenant_id, node_id, attr_name) of a wide table's cells that hold a value."""
    names = [c for c in table.columns if c not in ("tenant_id", "node_id", "failed")]
    if not names:
        return table.select("tenant_id", "node_id", F.lit("").alias("attr_name")).where("false")
    filled = F.filter(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), n) for n in names]), lambda x: x.isNotNull())
    return table.select("tenant_id", "node_id", F.explode(filled).alias("attr_name"))
