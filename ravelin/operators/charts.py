"""Declarative charts: what to draw, as a DataFrame of its rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ravelin.functions.periods import bucket
from ravelin.functions.predicates import apply_filters
from ravelin.operators.aggregates import AGGREGATIONS, aggregate
from ravelin.operators.quality import DatasetSchema
from ravelin.plans.ir import Filter

KINDS = ("bar", "line", "pie", "scatter", "histogram", "box", "heatmap")
MOST_CATEGORIES, MOST_SERIES, SCATTER_ROWS, BINS = 25, 8, 5000, 20
MISSING, OTHER = "(missing)", "Other"


@dataclass(frozen=True)
class ChartSpec:
    kind: str
    x: str
    y: str | None = None
    series: str | None = None
    aggregation: str = "count"
    grain: str | None = None
    filters: tuple[Filter, ...] = field(default=())
    sort: str = "value_desc"
    limit: int | None = None


def validate(spec: ChartSpec, schema: DatasetSchema) -> list[str]:
    """What keeps the chart from being drawn, in words."""
    roles = {c.name: c for c in schema.columns}
    out = [f"unknown column {c}" for c in (spec.x, spec.y, spec.series) if c and c not in roles]
    if spec.kind not in KINDS:
        out.append(f"unknown chart {spec.kind}")
    if spec.aggregation not in AGGREGATIONS and spec.aggregation != "none":
        out.append(f"unknown aggregation {spec.aggregation}")
    if not out and spec.aggregation not in ("count", "none", "count_distinct") and (not spec.y or roles[spec.y].role not in ("measure", "binary", "identifier")):
        out.append("the aggregation needs a measure")
    if not out and spec.grain and roles[spec.x].role != "time":
        out.append("a time grain needs a time column")
    if not out and spec.kind in ("scatter", "histogram") and roles[spec.x].role not in ("measure", "identifier", "binary"):
        out.append(f"a {spec.kind} needs a number")
    return out


def execute(spec: ChartSpec, df: DataFrame) -> DataFrame:
    """The rows of a chart: x [, series], value; scatter: x, y; histogram: bin, low, high, rows; box: x and five numbers."""
    d = apply_filters(df, spec.filters)
    if spec.kind == "scatter":
        # a seeded choice by row hash, the same in each run and on any cluster
        d = d.select(F.col(spec.x).alias("x"), F.col(spec.y).alias("y")).na.drop()
        return d.orderBy(F.xxhash64("x", "y"), "x", "y").limit(spec.limit or SCATTER_ROWS)
    if spec.kind == "histogram":
        return histogram(d, spec.x, spec.limit or BINS)
    if spec.kind == "box":
        g = d.na.drop(subset=[spec.y]).groupBy(F.coalesce(F.col(spec.x).cast("string"), F.lit(MISSING)).alias("x"))
        q = F.percentile(spec.y, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
        b = g.agg(F.count(F.lit(1)).alias("rows"), q.alias("q")).orderBy(F.desc("rows"), "x").limit(spec.limit or MOST_CATEGORIES)
        return b.select("x", "rows", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])
    x = bucket(spec.x, spec.grain) if spec.grain else F.coalesce(F.col(spec.x).cast("string"), F.lit(MISSING))
    by = [x.alias("x")]
    if spec.series:
        by.append(F.coalesce(F.col(spec.series).cast("string"), F.lit(MISSING)).alias("series"))
    d = d.where(F.col(spec.x).isNotNull()) if spec.grain else d
    if spec.series:
        from ravelin.operators.aggregates import keep_top

        n = d.select(spec.series).distinct().count()
        d = keep_top(d, spec.series, MOST_SERIES - 1, OTHER) if n > MOST_SERIES else d
    out = d.groupBy(*by).agg(aggregate(spec.aggregation, spec.y).alias("value"))
    return arrange(out, spec)


def arrange(out: DataFrame, spec: ChartSpec) -> DataFrame:
    """Sorts by x, or by each category's total over its series, and keeps the first categories."""
    if spec.grain or spec.sort == "x":
        out = out.orderBy("x", *(["series"] if spec.series else []))
        return out.limit(spec.limit) if spec.limit and not spec.series else out
    totals = out.groupBy("x").agg(F.sum("value").alias("_t"))
    up = spec.sort == "value_asc"
    first = totals.orderBy(F.asc("_t") if up else F.desc("_t"), "x").limit(spec.limit or MOST_CATEGORIES)
    d = out.join(F.broadcast(first), "x")
    order = [F.asc("_t") if up else F.desc("_t"), F.col("x"), *([F.col("series")] if spec.series else [])]
    return d.orderBy(*order).drop("_t")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, rows): equal widths from lowest to highest value; the highest falls in the last bin."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    d = df.select(x.alias("_x")).na.drop().join(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / F.when(width != 0, width))))
    return d.groupBy(at.cast("int").alias("bin")).agg(F.min(F.col("_lo") + at * width).alias("low"), F.max(F.col("_lo") + (at + 1) * width).alias("high"), F.count(F.lit(1)).alias("rows"))


def default_aggregation(schema: DatasetSchema, column: str | None) -> str:
    c = next((c for c in schema.columns if c.name == column), None)
    if c is None:
        return "count"
    if c.role == "measure":
        return "sum" if c.kind == "count" else "average"
    return "average" if c.role == "binary" and c.dtype != "string" else "count_distinct"


def recommend(df: DataFrame, schema: DatasetSchema, n: int = 6) -> list[tuple[float, ChartSpec]]:
    """Charts worth a look, best first: trends, group differences, scatters, distributions, compositions.

    A category or column comes up twice at most.
    """
    from ravelin.operators.relations import eta_squared, pearson_matrix, trend

    found: list[tuple[float, ChartSpec]] = []
    time, measures, dims = schema.primary_time(), schema.measures, [c.name for c in schema.columns if c.role in ("dimension", "binary") and not c.high_cardinality]
    for m in measures:
        if time:
            r = trend(df, time, m).first()
            found.append((70 + 30 * (r["r2"] or 0), ChartSpec("line", time, m, aggregation=default_aggregation(schema, m), grain="M")))
        for g in dims:
            e = eta_squared(df, g, m).first()["eta_squared"] or 0
            found.append((55 + min(45, 300 * e), ChartSpec("bar", g, m, aggregation=default_aggregation(schema, m))))
    if len(measures) > 1:
        found += [(50 + 45 * abs(r["pearson"]), ChartSpec("scatter", r["x"], r["y"], aggregation="none")) for r in pearson_matrix(df, measures).collect() if r["pearson"] is not None and 0.3 <= abs(r["pearson"]) < 0.95]
    if measures:
        from ravelin.functions.stats import adjusted_skewness

        skews = df.agg(*[adjusted_skewness(m).alias(m) for m in measures]).first()
        found += [(40 + min(25, 8 * abs(skews[m] or 0)), ChartSpec("histogram", m, aggregation="none")) for m in measures]
    found += [(35.0, ChartSpec("pie", g)) for g in dims]
    found.sort(key=lambda x: (-x[0], x[1].kind, x[1].x, x[1].y or ""))
    out, used = [], {}
    for s, c in found:
        keys = [("kind", c.kind), *[("col", v) for v in (c.x, c.y) if v and v != time]]
        if all(used.get(k, 0) < 2 for k in keys):
            out.append((s, c))
            for k in keys:
                used[k] = used.get(k, 0) + 1
    return out[:n]
