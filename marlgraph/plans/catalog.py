"""The mapping of relational tables to graph labels, and its small declaration language.

    NODE Label FROM table [JOIN table2] WITH id = column [PROPERTIES (a, b)]
    EDGE Label FROM table [JOIN table2] USING source -> target [PROPERTIES (a, b)]

Keywords are upper case across lines; with `relaxed` they may have any case, one statement stands on each line. Lines after # or // are comments.
A label that is declared twice has the last declaration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")


class MappingError(ValueError):
    """The text is no mapping."""


def check_identifier(name: str) -> str:
    """Only letters, digits and underscores may name tables and columns."""
    if not IDENTIFIER.fullmatch(name):
        raise MappingError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class NodeMapping:
    label: str
    table: str
    id_column: str
    properties: tuple[str, ...] = ()
    join_table: str | None = None


@dataclass(frozen=True)
class EdgeMapping:
    label: str
    table: str
    source_column: str
    target_column: str
    properties: tuple[str, ...] = ()
    join_table: str | None = None
    #: Labels of source and target; where they aren't given, `Catalog.ends` tells them by the columns' names.
    ends: tuple[str, str] | None = None


#: Labels that ids have room for.
LABELS = 64


@dataclass
class Catalog:
    """Mappings by label. In the graph a vertex's id is key * width + code: the code is the label's place among the declared ones, so that keys of two tables never meet.

    The last code stands for ends of edges whose label can't be told. A catalog of one label needs no codes, its width is 1.
    """

    nodes: dict[str, NodeMapping] = field(default_factory=dict)
    edges: dict[str, EdgeMapping] = field(default_factory=dict)

    def codes(self) -> dict[str, int]:
        return {label: i for i, label in enumerate(self.nodes)}

    def width(self) -> int:
        return LABELS if len(self.nodes) > 1 else 1

    def ends_of(self, edge: EdgeMapping) -> tuple[str | None, str | None]:
        """Labels of an edge's source and target: the only node with that id column, else the only one whose id column has that name after its prefix; None where that tells none."""
        if edge.ends:
            return edge.ends

        def label(column: str) -> str | None:
            same = [n.label for n in self.nodes.values() if n.id_column == column]
            bare = [n.label for n in self.nodes.values() if n.id_column.partition("_")[2] == column.partition("_")[2] != ""]
            found = same or bare
            return found[0] if len(found) == 1 else None

        return label(edge.source_column), label(edge.target_column)

    def add(self, mapping: NodeMapping | EdgeMapping) -> None:
        for name in (mapping.table, *mapping.properties, *([mapping.join_table] if mapping.join_table else []), *((mapping.id_column,) if isinstance(mapping, NodeMapping) else (mapping.source_column, mapping.target_column))):
            check_identifier(name)
        (self.nodes if isinstance(mapping, NodeMapping) else self.edges)[mapping.label] = mapping

    def summary(self) -> list[tuple[str, str]]:
        """(kind, label), sorted."""
        return sorted([("node", x) for x in self.nodes] + [("edge", x) for x in self.edges])

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.summary(), "kind string, label string")

    def text(self) -> str:
        """The declarations, as parse_catalog reads them."""
        rows = []
        for m in [*self.nodes.values(), *self.edges.values()]:
            kind, rest = ("NODE", f"WITH id = {m.id_column}") if isinstance(m, NodeMapping) else ("EDGE", f"USING {m.source_column} -> {m.target_column}")
            join = f" JOIN {m.join_table}" if m.join_table else ""
            rows.append(f"{kind} {m.label} FROM {m.table}{join} {rest}" + (f" PROPERTIES ({', '.join(m.properties)})" if m.properties else ""))
        return "\n".join(rows)


_ID = r"([A-Za-z0-9_]+)"
_END = rf"(?:\s+PROPERTIES\s*\(\s*({IDENTIFIER.pattern}(?:\s*,\s*{IDENTIFIER.pattern})*)\s*\))?"
_FROM = rf"\s+FROM\s+{_ID}(?:\s+JOIN\s+{_ID})?"
_NODE = rf"NODE\s+{_ID}{_FROM}\s+WITH\s+id\s*=\s*{_ID}{_END}"
_EDGE = rf"EDGE\s+{_ID}{_FROM}\s+USING\s+{_ID}\s*->\s*{_ID}{_END}"


def parse_catalog(text: str, relaxed: bool = False) -> Catalog:
    """Reads declarations; raises MappingError with the place of what is none."""
    catalog, flags = Catalog(), re.IGNORECASE if relaxed else 0
    node, edge = re.compile(rf"\s*{_NODE}(?=\s|$)", flags), re.compile(rf"\s*{_EDGE}(?=\s|$)", flags)
    plain = re.sub(r"(?:#|//)[^\n]*", "", text)

    def columns(found: str | None) -> tuple[str, ...]:
        return tuple(re.split(r"\s*,\s*", found)) if found else ()

    at = 0
    while plain[at:].strip():
        if m := node.match(plain, at):
            catalog.add(NodeMapping(m[1], m[2], m[4], columns(m[5]), m[3]))
        elif m := edge.match(plain, at):
            catalog.add(EdgeMapping(m[1], m[2], m[4], m[5], columns(m[6]), m[3]))
        else:
            begin = len(plain) - len(plain[at:].lstrip())
            raise MappingError(f"line {plain.count(chr(10), 0, begin) + 1}: no NODE or EDGE statement at {plain[begin : begin + 40]!r}")
        at = m.end()
    return catalog


def load_catalog(spark: SparkSession, path: str, relaxed: bool = False) -> Catalog:
    """Reads declarations from a file of any file system that the session knows."""
    text = spark.read.text(path, wholetext=True).first()
    return parse_catalog(text[0] if text else "", relaxed)


def save_catalog(spark: SparkSession, catalog: Catalog, path: str) -> None:
    """Writes the declarations to one file, replacing it as a whole."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = place.suffix(".writing")
    out = fs.create(fresh, True)
    out.write(bytearray(catalog.text() + "\n", "utf-8"))
    out.close()
    fs.delete(place, False)
    if not fs.rename(fresh, place):
        raise OSError(f"cannot write {path}")
