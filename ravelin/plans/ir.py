"""The small logical plan that questions, charts and programs share."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Operation(str, Enum):
    FILTER = "filter"
    COUNT = "count"
    SUM = "sum"
    AVERAGE = "average"
    MIN = "min"
    MAX = "max"
    ARGMAX = "argmax"
    ARGMIN = "argmin"
    TOP_N = "top_n"
    BOTTOM_N = "bottom_n"
    CHART = "chart"
    DESCRIBE = "describe"


@dataclass(frozen=True)
class Filter:
    """One predicate. ``op``: = != > < >= <= in not_in contains month quarter year."""

    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class QueryPlan:
    """What to compute over one table; ``compile_plan`` makes a DataFrame of it."""

    operation: Operation
    column: str | None = None
    filters: tuple[Filter, ...] = ()
    subject: str | None = None
    group_by: str | None = None
    aggregation: Operation = Operation.SUM
    limit: int | None = None
    time_grain: str | None = None
    chart_type: str | None = None
    keep_null_groups: bool = True
    notes: tuple[str, ...] = field(default=())
