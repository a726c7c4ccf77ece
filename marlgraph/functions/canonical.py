"""Canonical values of the feed's identifiers, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_table(x: str | Column) -> Column:
    """Trimmed, upper case."""
    return F.upper(F.trim(col_of(x)))


def canonical_key(x: str | Column) -> Column:
    """Trimmed, upper case, each |-separated component without leading zeros; a component of zeros only keeps one."""
    return F.regexp_replace(F.upper(F.trim(col_of(x))), r"(^|\|)0+(?=[^|])", "$1")


def canonical_tenant(x: str | Column) -> Column:
    """Null or empty means `default`."""
    c = col_of(x)
    return F.when(c.isNull() | (c == ""), F.lit("default")).otherwise(c)


def canonical_op(x: str | Column) -> Column:
    """Trimmed, upper case; null means PUT."""
    return F.coalesce(F.upper(F.trim(col_of(x))), F.lit("PUT"))
