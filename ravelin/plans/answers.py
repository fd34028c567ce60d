"""Sentences for results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ravelin.functions.names import format_number, humanize

from .ir import Filter, Operation
from .nl import Question

PHRASES = {"=": "is", "!=": "is not", ">": "is above", "<": "is below", ">=": "is at least", "<=": "is at most", "contains": "contains", "month": "falls in month", "quarter": "falls in quarter", "year": "falls in", "in": "is one of", "not_in": "is none of"}
NAMES = {Operation.SUM: "total", Operation.AVERAGE: "average", Operation.MIN: "lowest", Operation.MAX: "highest"}


def condition(f: Filter) -> str:
    value = format_number(f.value) if isinstance(f.value, float) else str(f.value)
    return f"{humanize(f.column)} {PHRASES[f.op]} {value}"


def sentence(q: Question, result: DataFrame | None, most: int = 5) -> str:
    """What the result says; for an unresolved question, what stopped it. At most ``most`` rows are read."""
    if result is None or q.plan is None:
        return "I could not place: " + ", ".join(q.unresolved) + "."
    p = q.plan
    where = " where " + " and ".join(map(condition, p.filters)) if p.filters else ""
    rows = result.limit(most + 1).collect()
    more = f" (and more than {most} in all)" if len(rows) > most else ""
    if not rows:
        return f"There is nothing{where}."
    if p.operation == Operation.COUNT and not p.group_by:
        what = humanize(p.column).lower() if p.column else "rows"
        return f"There are {format_number(rows[0]['value'])} {'different values of ' + what if p.column else what}{where}."
    if p.operation in NAMES and not p.group_by and not p.subject:
        name = humanize(p.column).lower()
        kind = "" if name.startswith(NAMES[p.operation]) else NAMES[p.operation] + " "
        return f"The {kind}{name}{where} is {format_number(rows[0]['value'])}."
    if p.operation in (Operation.TOP_N, Operation.BOTTOM_N):
        return f"{'Highest' if p.operation == Operation.TOP_N else 'Lowest'} by {humanize(p.column).lower()}{where}: " + ", ".join(f"{r[0]} ({format_number(r[1])})" for r in rows[:most]) + more + "."
    return f"Result{where}: " + "; ".join(", ".join(f"{humanize(k).lower()} {format_number(v)}" for k, v in r.asDict().items()) for r in rows[:most]) + more + "."
