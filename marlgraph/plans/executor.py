"""From a plan to one lazy DataFrame: a left-deep chain of inner equi-joins. Filters, columns and join strategies are left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.plans.planner import Plan, PlanError


def _scan(table: Callable[[str], DataFrame], name: str, joined: str | None, var: str) -> DataFrame:
    """The table's columns under names of their own for the variable; a second table is joined on the columns that both have."""
    rows = table(name)
    if joined:
        other = table(joined)
        shared = [c for c in rows.columns if c in other.columns]
        if not shared:
            raise PlanError(f"{name} and {joined} share no column")
        rows = rows.join(other, shared, "inner")
    return rows.select([F.col(f"`{c}`").alias(f"{var}\x1f{c}") for c in rows.columns])


def _equals(column: Column, kind: T.DataType, value: str | int, strict: bool) -> Column:
    """The literal takes the column's type; one that can't matches nothing, and null never matches. strict: a text only equals text, a number only whole numbers."""
    if strict and not isinstance(kind, T.StringType if isinstance(value, str) else T.IntegralType):
        return F.lit(False)
    return column == F.lit(value).cast("string").try_cast(kind)


def execute(plan: Plan, table: Callable[[str], DataFrame], declared: bool = False, strict: bool = False) -> DataFrame:
    """Returned variables become columns var_column; with properties, their names. The result has every match, repeats included.

    declared: a variable has only its key columns and the PROPERTIES of its mapping, so no other column is read or may be asked for. strict: no conversion between text and numbers.
    """
    at = lambda var, c: F.col(f"`{var}\x1f{c}`")
    owner = {plan.start_var: plan.start_var}
    rows = _scan(table, plan.start.table, plan.start.join_table, plan.start_var)

    for hop in plan.hops:
        e, source = hop.edge, hop.source_var
        source_id = at(owner[source], next(h.target.id_column for h in plan.hops if h.target_var == source) if source != plan.start_var else plan.start.id_column)
        near, far = (e.source_column, e.target_column) if hop.direction != "in" else (e.target_column, e.source_column)
        if hop.same_as == "source":
            owner[hop.edge_var] = owner[source]
            target = _scan(table, hop.target.table, hop.target.join_table, hop.target_var)
            owner[hop.target_var] = hop.target_var
            rows = rows.join(target, at(owner[source], far) == at(hop.target_var, hop.target.id_column))
            continue
        if hop.same_as == "target":
            target = _scan(table, hop.target.table, None, hop.target_var)
            owner[hop.target_var] = owner[hop.edge_var] = hop.target_var
            rows = rows.join(target, source_id == at(hop.target_var, near))
            continue
        edge = _scan(table, e.table, e.join_table, hop.edge_var)
        if hop.direction == "both":
            ends = lambda a, b: edge.withColumns({"\x1fnear": at(hop.edge_var, a), "\x1ffar": at(hop.edge_var, b)})
            edge = ends(e.source_column, e.target_column).unionByName(ends(e.target_column, e.source_column))
            near_col, far_col = F.col("`\x1fnear`"), F.col("`\x1ffar`")
        else:
            near_col, far_col = at(hop.edge_var, near), at(hop.edge_var, far)
        target = _scan(table, hop.target.table, hop.target.join_table, hop.target_var)
        owner[hop.edge_var], owner[hop.target_var] = hop.edge_var, hop.target_var
        rows = rows.join(edge, source_id == near_col).join(target, far_col == at(hop.target_var, hop.target.id_column))
        rows = rows.drop("\x1fnear", "\x1ffar")

    known: dict[str, tuple[str, ...]] = {plan.start_var: (plan.start.id_column, *plan.start.properties)}
    for hop in plan.hops:
        known[hop.edge_var] = (hop.edge.source_column, hop.edge.target_column, *hop.edge.properties)
        known[hop.target_var] = (hop.target.id_column, *hop.target.properties)

    def has(var: str, name: str) -> bool:
        return f"{owner[var]}\x1f{name}" in rows.columns and (not declared or name in known[var])

    def column(var: str, name: str) -> str:
        full = f"{owner[var]}\x1f{name}"
        if not has(var, name):
            raise PlanError(f"'{var}' has no column '{name}'")
        return full

    if plan.conditions:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        tests = [reduce(lambda a, b: a | b, [_equals(F.col(f"`{c}`"), kinds[c], v, strict) for v in cond.values]) for cond in plan.conditions for c in [column(cond.var, cond.prop)]]
        rows = rows.where(reduce(lambda a, b: a & b, tests))
    out = []
    for item in plan.returns:
        if item.prop:
            out.append(F.col(f"`{column(item.var, item.prop)}`").alias(item.name or f"{item.var}_{item.prop}"))
        else:
            prefix = f"{owner[item.var]}\x1f"
            out += [F.col(f"`{c}`").alias(f"{item.var}_{c[len(prefix) :]}") for c in rows.columns if c.startswith(prefix) and has(item.var, c[len(prefix) :])]
    rows = rows.select(out)
    return rows if plan.limit is None else rows.limit(plan.limit)


def all_strings(rows: DataFrame) -> DataFrame:
    """Every column as text; null stays null and an empty result keeps its schema."""
    return rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))
