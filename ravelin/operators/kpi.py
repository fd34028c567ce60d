"""Key figures declared in YAML or as dataclasses, over several tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ravelin.functions.periods import bucket, last_is_complete

OPERATIONS = ("count", "sum", "mean", "min", "max", "distinct")
ORDERINGS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "ne": "!=", "eq": "="}


@dataclass(frozen=True)
class Aggregate:
    """op over ``column`` of ``table``, of rows that meet ``where`` (column -> value, list, or {gt, ge, lt, le, ne, eq: value})."""

    table: str
    op: str
    column: str | None = None
    where: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Kpi:
    """An aggregate, or the ratio of two that may come from different tables."""

    name: str
    value: Aggregate
    divisor: Aggregate | None = None
    direction: str = "up"


@dataclass(frozen=True)
class Roles:
    """The columns that hold a table's date and groups: role name -> column."""

    date: str | None = None
    groups: dict[str, str] = field(default_factory=dict)


def parse(config: dict) -> tuple[dict[str, Roles], list[Kpi]]:
    """Roles and figures from parsed YAML; what is wrong with it is told in full."""
    problems: list[str] = []

    def aggregate(name: str, d: dict) -> Aggregate:
        if d.get("op") not in OPERATIONS:
            problems.append(f"{name}: op must be one of {', '.join(OPERATIONS)}")
        if "table" not in d:
            problems.append(f"{name}: table is missing")
        if d.get("op") != "count" and not d.get("column"):
            problems.append(f"{name}: column is missing")
        return Aggregate(d.get("table", ""), d.get("op", "count"), d.get("column"), d.get("where") or {})

    roles = {t: Roles(r.get("date"), r.get("groups") or {}) for t, r in (config.get("tables") or {}).items()}
    kpis = []
    for d in config.get("kpis") or []:
        name = d.get("name") or "a figure without name"
        kpis.append(Kpi(name, aggregate(name, d.get("value") or d), aggregate(name, d["divisor"]) if d.get("divisor") else None, d.get("direction", "up")))
    if len({k.name for k in kpis}) < len(kpis):
        problems.append("two figures share a name")
    if problems:
        raise ValueError("; ".join(problems))
    return roles, kpis


def load(path: str) -> tuple[dict[str, Roles], list[Kpi]]:
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f) or {})


def condition(where: dict) -> Column:
    out = F.lit(True)
    for c, v in where.items():
        col = F.col(f"`{c}`")
        if isinstance(v, dict):
            for op, x in v.items():
                number = F.expr(f"try_cast(`{c}` as double)")
                test = {"gt": number > F.lit(x), "ge": number >= F.lit(x), "lt": number < F.lit(x), "le": number <= F.lit(x)}.get(op) if op in ("gt", "ge", "lt", "le") else ~col.eqNullSafe(F.lit(x)) if op == "ne" else col == F.lit(x)
                out = out & test
        else:
            out = out & (col.isin(v) if isinstance(v, (list, tuple)) else col == F.lit(v))
    return F.coalesce(out, F.lit(False))


def expression(a: Aggregate) -> Column:
    """The aggregate as a conditional one, so all figures of a table come from one pass over it."""
    ok = condition(a.where)
    x = F.col(f"`{a.column}`") if a.column else F.lit(1)
    kept = F.when(ok, x)
    return {"count": F.count(kept), "sum": F.sum(kept), "mean": F.avg(kept), "min": F.min(kept), "max": F.max(kept), "distinct": F.count_distinct(kept)}[a.op].cast("double")


def evaluate(tables: dict[str, DataFrame], roles: dict[str, Roles], kpis: list[Kpi], grain: str | None = "M", group: str | None = None) -> DataFrame:
    """(kpi, period, group, value): every figure in every period and group.

    Each table is aggregated once for all its figures; the small results meet by period and group. A table without a date
    counts in all periods. A ratio is null where its divisor is 0 or missing.
    """
    parts: dict[str, list[tuple[str, Aggregate]]] = {}
    for k in kpis:
        parts.setdefault(k.value.table, []).append((f"{k.name}|v", k.value))
        if k.divisor:
            parts.setdefault(k.divisor.table, []).append((f"{k.name}|d", k.divisor))
    long, undated = None, None
    for t, items in parts.items():
        r = roles.get(t, Roles())
        by = []
        if grain and r.date:
            by.append(bucket(r.date, grain).alias("period"))
        g = r.groups.get(group) if group else None
        if g:
            by.append(F.col(f"`{g}`").cast("string").alias("group"))
        d = tables[t].where(F.col(r.date).isNotNull()) if grain and r.date else tables[t]
        d = d.groupBy(*by).agg(*[expression(a).alias(n) for n, a in items])
        names = [n for n, _ in items]
        stacked = d.select(*[c for c in ("period", "group") if c in d.columns], F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("x")) for n in names])).alias("s"))
        for c, kind in (("period", "timestamp_ntz"), ("group", "string")):
            if c not in stacked.columns:
                stacked = stacked.withColumn(c, F.lit(None).cast(kind))
        stacked = stacked.select("s.name", "period", "group", F.col("s.x").alias("x"))
        if grain and not r.date:
            undated = stacked if undated is None else undated.unionByName(stacked)
        else:
            long = stacked if long is None else long.unionByName(stacked)
    if undated is not None:
        periods = long.select("period").distinct() if long is not None else tables[next(iter(tables))].sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("period"))
        # periods are few and undated figures a row each: a small product
        undated = undated.drop("period").join(F.broadcast(periods)).select("name", "period", "group", "x")
        long = undated if long is None else long.unionByName(undated)
    name, side = F.substring_index("name", "|", 1), F.substring_index("name", "|", -1)
    d = long.groupBy(name.alias("kpi"), "period", "group").agg(F.max(F.when(side == "v", F.col("x"))).alias("v"), F.max(F.when(side == "d", F.col("x"))).alias("d"))
    ratios = [k.name for k in kpis if k.divisor]
    value = F.when(F.col("kpi").isin(ratios), F.try_divide("v", F.when(F.col("d") != 0, F.col("d")))).otherwise(F.col("v")) if ratios else F.col("v")
    return d.select("kpi", "period", "group", value.alias("value"))


def trend(values: DataFrame, kpis: list[Kpi], newest, grain: str = "M", periods: int = 12) -> DataFrame:
    """(kpi, group, period, value, previous, change, status): the last periods, each with the one before it.

    A last period that is hardly begun by ``newest`` is left out, if at least three are there.
    """
    from pyspark.sql import Window as W

    last = [r[0] for r in values.select("period").na.drop().distinct().orderBy(F.desc("period")).limit(periods + 2).collect()]
    if len(last) >= 3 and newest is not None and not last_is_complete(last[0], newest, grain):
        last = last[1:]
    up = [k.name for k in kpis if k.direction == "up"]
    d = values.where(F.col("period").isin(last[: periods + 1])).withColumn("previous", F.lag("value").over(W.partitionBy("kpi", "group").orderBy("period")))
    d = d.withColumn("change", F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")))
    better = (F.col("value") > F.col("previous")) == F.col("kpi").isin(up)
    d = d.withColumn("status", F.when(F.col("previous").isNull() | F.col("value").isNull() | (F.col("value") == F.col("previous")), "").when(better, "better").otherwise("worse"))
    return d.where(F.col("period").isin(last[:periods]))


def starter(tables: dict[str, DataFrame]) -> dict:
    """A first configuration for tables: row counts, sums of measures, distinct keys, rates of two-valued columns."""
    from ravelin.operators.quality import infer_schema

    config: dict = {"tables": {}, "kpis": []}
    for t, df in tables.items():
        s = infer_schema(df)
        config["tables"][t] = {"date": s.primary_time(), "groups": {c: c for c in s.named("dimension")[:2]}}
        config["kpis"].append({"name": f"{t} rows", "value": {"table": t, "op": "count"}})
        config["kpis"] += [{"name": f"{t} {c}", "value": {"table": t, "op": "sum" if k != "ratio" else "mean", "column": c}} for c, k in ((x.name, x.kind) for x in s.columns if x.role == "measure")]
        config["kpis"] += [{"name": f"{t} distinct {c}", "value": {"table": t, "op": "distinct", "column": c}} for c in s.named("identifier")]
    return config
