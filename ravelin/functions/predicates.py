"""Predicates with the null rules of the query language: all are false on null, but != and not_in are true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ravelin.plans.ir import Filter

COMPARISONS = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
    "<>": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(v)))),
    "month": lambda c, v: F.month(c) == v,
    "quarter": lambda c, v: F.quarter(c) == v,
    "year": lambda c, v: F.year(c) == v,
}


def predicate(f: Filter) -> Column:
    """A filter as a Catalyst predicate (comparisons with literals reach the Parquet scan)."""
    if f.op not in COMPARISONS:
        raise ValueError(f"unknown operator {f.op!r}")
    return COMPARISONS[f.op](F.col(f"`{f.column}`"), f.value)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """All filters, joined by and; a column that the table lacks is refused."""
    for f in filters:
        if f.column not in df.columns:
            raise ValueError(f"unknown column {f.column!r}")
        df = df.where(predicate(f))
    return df


def code_key(column: Column) -> Column:
    """(prefix in lower case, number) of an identifier like MR001, null for other values."""
    pattern = r"^([A-Za-z]+)[-_ #]?(\d+)$"
    return F.when(column.rlike(pattern), F.struct(F.lower(F.regexp_extract(column, pattern, 1)).alias("prefix"), F.regexp_extract(column, pattern, 2).cast("long").alias("number")))
