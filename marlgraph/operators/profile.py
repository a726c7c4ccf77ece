"""Profiling of tables: unique columns, inclusion dependencies and a draft mapping.

Three jobs, whatever the number of tables and columns. The first counts values, sketches distinct values and takes bounds. Exact work is done only where that leaves a
doubt: a column whose sketch is far below its count can't be unique, and a column whose bounds lie outside another's can't be included in it. The second
groups the values of all columns that may be unique by column; the third groups the values of all columns in doubt by value, with a bit per column, and
a pair is broken by a value that has the one bit and not the other.

Cases: a column of nulls is neither unique nor a source; an empty table has no unique columns; nulls are ignored; types that can't be compared are skipped;
decimals are compared with decimals only.
"""

from __future__ import annotations

import string
from collections.abc import Collection, Iterable
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.plans.catalog import Catalog, EdgeMapping, NodeMapping

#: Error of the sketch, and how far below the count it rules uniqueness out.
ERROR, DOUBT = 0.02, 0.85
#: Families of types whose values can be compared, with the type in which they are.
FAMILIES = {"whole": "bigint", "text": "string", "time": "timestamp", "number": "double", "decimal": "decimal(38,18)"}
#: Columns in one word of bits.
WORD = 62

Place = tuple[str, str]


def _family(kind: T.DataType) -> str | None:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "number" if isinstance(kind, (T.DoubleType, T.FloatType)) else "decimal" if isinstance(kind, T.DecimalType) else None


def _value(column: str, family: str) -> Column:
    return F.col(f"`{column}`").cast(FAMILIES[family])


def _union(parts: Iterable[DataFrame]) -> DataFrame | None:
    parts = list(parts)
    return reduce(DataFrame.unionByName, parts) if parts else None


def _values(tables: dict[str, DataFrame], places: dict[Place, int], family: str) -> DataFrame:
    """(place, v): the non-null values of the numbered columns, with one scan per table."""
    parts = []
    for t in sorted({t for t, _ in places}):
        own = [F.struct(F.lit(i).alias("place"), _value(c, family).alias("v")) for (table, c), i in places.items() if table == t]
        parts.append(tables[t].select(F.explode(F.array(*own)).alias("e")).select("e.*").where("v IS NOT NULL"))
    return _union(parts)


def profile(tables: dict[str, DataFrame], families: Collection[str] = tuple(FAMILIES)) -> dict[str, dict[str, dict]]:
    """For each table and comparable column: count, sketched distinct, bounds, type family, and whether it is unique. families: those looked at."""
    looked = {(t, f.name): _family(f.dataType) for t, rows in tables.items() for f in rows.schema.fields if _family(f.dataType) in families}
    parts = []
    for t, rows in tables.items():
        own = [(c, k) for (table, c), k in looked.items() if table == t]
        if not own:
            continue
        facts = [a for i, (c, k) in enumerate(own) for v in [_value(c, k)] for a in (F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, ERROR).alias(f"d{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"))]
        bound = lambda name, k: [F.col(name).cast(kind).alias(f"{name[0]}_{f}") if f == k else F.lit(None).cast(kind).alias(f"{name[0]}_{f}") for f, kind in FAMILIES.items()]
        each = [F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d"), *bound(f"l{i}", k), *bound(f"h{i}", k)) for i, (c, k) in enumerate(own)]
        parts.append(rows.agg(*facts).select(F.explode(F.array(*each)).alias("e")).select("e.*"))
    out: dict[str, dict[str, dict]] = {t: {} for t in tables}
    facts = _union(parts)
    if facts is None:
        return out
    rows = {(r["t"], r["c"]): r for r in facts.collect()}  # a row per column
    for (t, c), k in looked.items():
        r = rows[t, c]
        out[t][c] = {"count": r["n"], "distinct": r["d"], "low": r[f"l_{k}"], "high": r[f"h_{k}"], "family": k, "unique": r["n"] > 0 and r["d"] >= DOUBT * r["n"]}
    doubtful = {place: i for i, place in enumerate(p for p in looked if out[p[0]][p[1]]["unique"])}
    repeated = _union(
        _values(tables, own, k).groupBy("place", "v").count().where("count > 1").select("place")
        for k in FAMILIES if (own := {p: i for p, i in doubtful.items() if looked[p] == k})
    )
    if repeated is not None:
        names = list(doubtful)
        for r in repeated.distinct().collect():
            t, c = names[r["place"]]
            out[t][c]["unique"] = False
    return out


def inclusions(tables: dict[str, DataFrame], found: dict[str, dict[str, dict]]) -> list[tuple[str, str, str, str]]:
    """(source table, column, target table, unique column) where every value of the source is one of the target's, sorted."""
    columns = {(t, c): p for t, own in found.items() for c, p in own.items() if p["count"]}
    uniques = {u: q for u, q in columns.items() if q["unique"]}
    possible = [
        (s, u) for s, p in columns.items() for u, q in uniques.items()
        if u[0] != s[0] and p["family"] == q["family"] and q["low"] <= p["low"] and p["high"] <= q["high"] and p["distinct"] <= q["distinct"] * (1 + 4 * ERROR)
    ]
    broken = _union(_broken(tables, own, k) for k in FAMILIES if (own := {i: pair for i, pair in enumerate(possible) if columns[pair[0]]["family"] == k}))
    gone = {r[0] for r in broken.distinct().collect()} if broken is not None else set()
    return sorted((*s, *u) for i, (s, u) in enumerate(possible) if i not in gone)


def _broken(tables: dict[str, DataFrame], pairs: dict[int, tuple[Place, Place]], family: str) -> DataFrame:
    """The numbers of the pairs of which a value is in the source and not in the target."""
    places = {place: i for i, place in enumerate(sorted({x for pair in pairs.values() for x in pair}))}
    words = -(-len(places) // WORD)
    bit = F.expr(f"shiftleft(1L, place % {WORD})")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / WORD) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(words)]
    seen = _values(tables, places, family).groupBy("v").agg(*masks).select(F.array(*[f"w{w}" for w in range(words)]).alias("words")).distinct()
    tests = F.array(*[F.struct(F.lit(i).alias("pair"), *[x for name, p in (("s", places[s]), ("u", places[u])) for x in (F.lit(p // WORD).alias(f"{name}w"), F.lit(1 << p % WORD).cast("long").alias(f"{name}m"))]) for i, (s, u) in pairs.items()])
    breaks = F.filter(tests, lambda p: (F.get("words", p["sw"]).bitwiseAND(p["sm"]) != 0) & (F.get("words", p["uw"]).bitwiseAND(p["um"]) == 0))
    return seen.select(F.explode(breaks).alias("p")).select("p.pair")


# --- the draft mapping ------------------------------------------------------------------------------------------------------------------

#: What drafted edges are called, by the part that the referring column plays; the part of a name that marks keys; what stands for a missing key. Fixed values.
EDGE_NAMES = {"detail": "PartOf", "address": "LocatedAt", "party": "HasParty_{column}", "reference": "RefersTo_{target}"}
KEY_MARK, NO_KEY = "id", "UNKNOWN_ID"


def node_label(table: str) -> str:
    return string.capwords(table, "_").replace("_", "")


def affinity(column: str, table: str) -> float:
    """How well a column's name suits the key of a table, 0 to 1: the longest piece of it that the names share, measured by the shorter one; 1 with the key mark."""
    a, b = column.casefold(), table.casefold()
    if KEY_MARK in a:
        return 1.0
    piece = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    return piece.size / max(1, min(len(a), len(b)))


def primary_id(table: str, unique: list[str]) -> str:
    """The first unique column of full affinity, else the first one, else NO_KEY."""
    return min(unique, key=lambda c: affinity(c, table) < 1, default=NO_KEY)  # of equal ones min takes the first


def part_of_reference(source: str, column: str, target: str) -> str:
    """The part that a column referring from one table to another plays, a key of EDGE_NAMES."""
    *head, last = source.split("_")
    parts = {"detail": last == "items" and "_".join(head) + "s" == target, "address": (source, target) == ("customers", "addresses"), "party": "party" in column.casefold(), "reference": True}
    return next(name for name, holds in parts.items() if holds)


def edge_label(source: str, column: str, target: str) -> str:
    return EDGE_NAMES[part_of_reference(source, column, target)].format(column=column, target=target)


def draft_mapping(found: dict[str, dict[str, dict]], pairs: list[tuple[str, str, str, str]]) -> Catalog:
    """A mapping to start from. Edges lead from a source's id to the referring column, and later ones of one label get the column's name."""
    catalog = Catalog()
    ids = {t: primary_id(t, [c for c, p in columns.items() if p["unique"]]) for t, columns in found.items()}
    for t, c in ids.items():
        catalog.add(NodeMapping(node_label(t), t, c))
    for s, c, t, _ in pairs:
        label = edge_label(s, c, t)
        catalog.add(EdgeMapping(label if label not in catalog.edges else f"{label}_{s}_{c}", s, ids[s], c))
    return catalog


def as_frame(spark: SparkSession, found: dict[str, dict[str, dict]]) -> DataFrame:
    rows = sorted((t, c, int(p["count"]), bool(p["unique"])) for t, columns in found.items() for c, p in columns.items())
    return spark.createDataFrame(rows, "table_name string, column_name string, non_null long, is_unique boolean")


def schema_text(tables: dict[str, DataFrame]) -> str:
    """The tables' columns and types as text, for reading."""
    return "\n".join(line for t, rows in tables.items() for line in [f"{t}:", *(f"  {f.name}: {f.dataType.simpleString()}" for f in rows.schema.fields)])
