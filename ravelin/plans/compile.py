"""Compiles a QueryPlan to a lazy DataFrame. Catalyst does the rest: pruning, pushdown, partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ravelin.functions.periods import bucket
from ravelin.functions.predicates import apply_filters
from ravelin.operators import aggregates as agg

from .ir import Operation, QueryPlan

SCALARS = {Operation.SUM: "sum", Operation.AVERAGE: "average", Operation.MIN: "min", Operation.MAX: "max"}
CHARTS = SCALARS | {Operation.COUNT: "count"}
MOST_ROWS = 1000


def require(df: DataFrame, *columns: str | None) -> None:
    for c in columns:
        if c is not None and c not in df.columns:
            raise ValueError(f"unknown column {c!r}")


def require_number(df: DataFrame, column: str | None) -> None:
    if column is None:
        raise ValueError("the operation needs a column")
    if dict(df.dtypes)[column].split("(")[0] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"):
        raise ValueError(f"{column!r} is no number")


def compile_plan(plan: QueryPlan, df: DataFrame) -> DataFrame:
    """The result of the plan over df; column names: group, subject or entity as they are, aggregates as ``value``.

    Sums and averages over no rows are 0, extremes null. Grouped results keep a null group unless the plan says not to.
    """
    require(df, plan.column, plan.subject, plan.group_by)
    d, op = apply_filters(df, plan.filters), plan.operation
    if op == Operation.FILTER:
        if plan.subject and plan.column and plan.subject != plan.column:
            return d.select(plan.subject, plan.column).distinct()
        if plan.subject:
            return agg.entities(d, plan.subject)
        return d.select(plan.column) if plan.column else d
    if op == Operation.COUNT:
        how = "count" if plan.column is None else "count_distinct"
        if plan.group_by:
            return agg.grouped(d, plan.group_by, how, plan.column, keep_nulls=plan.keep_null_groups)
        return agg.scalar(d, how, plan.column)
    if op in SCALARS:
        if op in (Operation.SUM, Operation.AVERAGE):
            require_number(df, plan.column)
        if op in (Operation.MIN, Operation.MAX) and plan.subject:
            return agg.extreme_rows(d, plan.column, plan.subject, op == Operation.MAX)
        if plan.group_by:
            out = agg.grouped(d, plan.group_by, SCALARS[op], plan.column, keep_nulls=plan.keep_null_groups)
            return out.orderBy(F.asc_nulls_last(plan.group_by))
        return agg.scalar(d, SCALARS[op], plan.column)
    if op in (Operation.ARGMAX, Operation.ARGMIN):
        return agg.extreme_rows(d, plan.column, plan.subject, op == Operation.ARGMAX)
    if op in (Operation.TOP_N, Operation.BOTTOM_N):
        require_number(df, plan.column)
        return agg.ranked_groups(d, plan.subject or plan.group_by, plan.column, 10 if plan.limit is None else plan.limit, op == Operation.TOP_N)
    if op == Operation.DESCRIBE:
        require_number(df, plan.column)
        return agg.describe(d, plan.column)
    if op == Operation.CHART:
        if plan.group_by is None:
            require_number(df, plan.column)
            return agg.describe(d, plan.column)
        d = d.na.drop(subset=[plan.group_by])
        how = CHARTS[plan.aggregation]
        column = plan.column
        if plan.time_grain:
            d = d.withColumn(plan.group_by, bucket(plan.group_by, plan.time_grain))
        out = d.groupBy(plan.group_by).agg(agg.aggregate(how, column).alias("value"))
        out = out.orderBy(plan.group_by) if plan.time_grain else out.orderBy(F.desc("value"), plan.group_by)
        return out.limit(plan.limit) if plan.limit else out
    raise ValueError(f"no way to compute {op}")
