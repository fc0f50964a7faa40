"""Validated query plans over a table: filter, group, aggregate, sort, limit.

A plan is data, not code: column names are resolved against the table (case and
accents aside), operators come from a fixed list.  `compile_plan` turns it into
one DataFrame, which Catalyst optimises; nothing is evaluated here.

Null cells are empty texts in filters, never SQL nulls.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_or_empty, fold_value, to_number

MOST_ROWS, USUAL_ROWS = 50, 20
COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
FUNCTIONS = ("sum", "avg", "count", "min", "max")


class PlanError(ValueError):
    """The plan does not fit the table."""


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: str | float


@dataclass(frozen=True)
class Measure:
    fn: str
    column: str = "*"


@dataclass(frozen=True)
class TablePlan:
    filters: tuple[Condition, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Measure, ...] = ()
    select: tuple[str, ...] = ()
    sort_by: str | None = None
    descending: bool = True
    limit: Any = USUAL_ROWS

    @property
    def rows(self) -> int:
        try:
            return max(1, min(int(self.limit), MOST_ROWS))
        except (TypeError, ValueError):
            return USUAL_ROWS

    @classmethod
    def from_dict(cls, plan: dict[str, Any]) -> TablePlan:
        unknown = set(plan) - set(cls.__dataclass_fields__)
        if unknown:
            raise PlanError(f"unknown parts of a plan: {sorted(unknown)}")
        parts = dict(plan)
        parts["filters"] = tuple(Condition(**c) for c in plan.get("filters", ()))
        parts["aggregates"] = tuple(Measure(**m) for m in plan.get("aggregates", ()))
        for name in ("group_by", "select"):
            parts[name] = tuple(plan.get(name, ()))
        return cls(**parts)


@dataclass
class _Table:
    df: DataFrame
    types: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self.types = dict(self.df.dtypes)

    def resolve(self, name: str, among: list[str] | None = None) -> str:
        if name == "*":
            return name
        wanted = fold_value(name)
        for column in among if among is not None else self.df.columns:
            if fold_value(column) == wanted:
                return column
        raise PlanError(f"no column {name!r}")

    def cell(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def number(self, name: str) -> Column:
        return to_number(self.cell(name), self.types[name])

    def text(self, name: str) -> Column:
        return fold_or_empty(self.cell(name).cast("string"))


def condition(table: _Table, item: Condition) -> Column:
    """Numbers are compared where both sides are numbers, folded texts elsewhere."""
    name = table.resolve(item.column)
    text, wanted = table.text(name), fold_value(str(item.value))
    if item.op == "contains":
        return F.contains(text, F.lit(wanted))
    if item.op not in COMPARE:
        raise PlanError(f"no operator {item.op!r}")
    compare, as_text = COMPARE[item.op], COMPARE[item.op](text, F.lit(wanted))
    if isinstance(item.value, str) or isinstance(item.value, bool):
        return F.coalesce(compare(table.number(name), to_number(F.lit(item.value), "string" if isinstance(item.value, str) else "boolean")), as_text)
    typed = compare(table.number(name), F.lit(float(item.value)))
    # a null cell is an empty text: smaller than any number's text, and equal to none
    return typed if table.types[name] != "string" and item.op in ("=", ">", ">=") else F.coalesce(typed, as_text)


def measure(table: _Table, item: Measure) -> Column:
    name = table.resolve(item.column)
    if item.fn not in FUNCTIONS:
        raise PlanError(f"no aggregate {item.fn!r}")
    title = f"{item.fn}({name})"
    if item.fn == "count":
        if name == "*":
            return F.count("*").alias(title)
        cell = table.cell(name)
        full = F.trim(cell.cast("string")) != ""
        if table.types[name] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz"):
            full = cell != 0  # a zero counts as an empty cell
        elif table.types[name] == "boolean":
            full = cell
        return F.count(F.when(full, 1)).alias(title)
    if name == "*":
        raise PlanError("only count takes all rows")
    return getattr(F, item.fn)(table.number(name)).alias(title)


def compile_plan(plan: TablePlan | dict[str, Any], df: DataFrame, order: Column | str | None = None) -> DataFrame:
    """The plan's result; `order` (a column of df) breaks ties of the sort as the table's own order."""
    plan = plan if isinstance(plan, TablePlan) else TablePlan.from_dict(plan)
    table = _Table(df)
    kept = df.where(reduce(operator.and_, (condition(table, c) for c in plan.filters))) if plan.filters else df
    tie = None
    if plan.aggregates:
        keys = [table.resolve(k) for k in plan.group_by]
        measures = [measure(table, m) for m in plan.aggregates]
        if order is not None:
            measures.append(F.min(order).alias("__order"))
        out = kept.groupBy(*(table.cell(k) for k in keys)).agg(*measures)
        tie = "__order" if order is not None else None
    elif plan.select:
        columns = [table.cell(table.resolve(c)) for c in plan.select]
        out = kept.select(*columns, *([(F.col(order) if isinstance(order, str) else order).alias("__order")] if order is not None else []))
        tie = "__order" if order is not None else None
    else:
        raise PlanError("nothing to show or to compute")
    if plan.sort_by:
        shown = [c for c in out.columns if c != "__order"]
        name = plan.sort_by if plan.sort_by in shown else table.resolve(plan.sort_by, shown)
        kind = dict(out.dtypes)[name]
        number, text = to_number(F.col(f"`{name}`"), kind), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        parts = [number.isNull().cast("int"), number, F.when(number.isNull(), text)]
        keys = [p.desc() if plan.descending else p.asc() for p in parts]
        out = out.orderBy(*keys, *([F.col(tie).asc()] if tie else []))
    elif tie:
        out = out.orderBy(tie)
    out = out.limit(plan.rows)
    return out.drop("__order") if tie else out


def to_markdown(df: DataFrame, title: str = "", rows: int = MOST_ROWS) -> str:
    """A pipe table of at most MOST_ROWS rows."""
    from ..functions.text import local_number, table_cell

    shown = df.limit(min(rows, MOST_ROWS)).select(
        *(F.coalesce(local_number(F.col(f"`{c}`")) if t in ("double", "float") else table_cell(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c, t in df.dtypes)
    )
    lines = [title, ""] if title else []
    lines += ["| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in shown.collect()])
