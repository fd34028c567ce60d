"""The report on a target: what it is, what goes with it, what must be left out, how to split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ravelin.operators import target
from ravelin.operators.quality import DatasetSchema

CRITICAL, LOW = 0.02, 0.10
MOST_LEVELS = 50


def exclusions(schema: DatasetSchema, label: str, leaked: dict[str, str]) -> dict[str, str]:
    """Columns that a model must not have, with the reason."""
    out = {}
    for c in schema.columns:
        if c.name == label:
            continue
        if c.name in leaked:
            out[c.name] = leaked[c.name]
        elif c.role in ("empty", "constant"):
            out[c.name] = f"is {c.role}"
        elif c.role in ("identifier", "time", "text"):
            out[c.name] = f"is of role {c.role}"
        elif c.role == "dimension" and (c.high_cardinality or c.n_unique > MOST_LEVELS):
            out[c.name] = "has too many values"
    return out


def balance(df: DataFrame, label: str) -> DataFrame:
    """(rows, labelled, positives, rate, severity) of a 0/1 column."""
    d = df.agg(F.count(F.lit(1)).alias("rows"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"))
    d = d.withColumn("rate", F.try_divide("positives", "labelled"))
    small = F.least(F.col("rate"), 1 - F.col("rate"))
    return d.withColumn("severity", F.when(small < CRITICAL, "critical").when(small < LOW, "warning").otherwise(""))


def signals(df: DataFrame, label: str, numbers: list[str], dimensions: list[str]) -> DataFrame:
    """(column, kind, strength): how much each column alone tells of the target; ordered, strongest first."""
    from ravelin.operators.relations import association

    rows = [(c, "number", float(target.auc(df, c, label).first()["strength"] or 0.0)) for c in numbers]
    rows += [(c, "category", float(association(df, c, label)[2])) for c in dimensions]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[2], r[0])) or [("", "", 0.0)], "column string, kind string, strength double")


def markdown(df: DataFrame, schema: DatasetSchema, column: str, grain: str = "M") -> str:
    """The report as a text: figures come from the tables above and nowhere else."""
    d = df.withColumn("_y", target.positive(df, column))
    numbers = [m for m in schema.measures if m != column]
    dims = [c.name for c in schema.columns if c.role in ("dimension", "binary") and not c.high_cardinality and c.name != column]
    b = balance(d, "_y").first()
    leaked = {r["column"]: r["reason"] for r in target.leaks(d, "_y", numbers, dims).collect()}
    lines = [f"# Target {column}", "", f"{b['rows']:,} rows, {b['labelled']:,} labelled, {b['positives']:,} positive ({(b['rate'] or 0):.1%})."]
    if b["severity"]:
        lines.append(f"The outcome is rare ({b['severity']}).")
    lines += ["", "## Signals", "", "| column | kind | strength |", "|-|-|-|"]
    lines += [f"| {r['column']} | {r['kind']} | {r['strength']:.3f} |" for r in signals(d, "_y", numbers, dims).collect()]
    lines += ["", "## Left out", ""] + [f"- {c}: {why}" for c, why in exclusions(schema, column, leaked).items()]
    time = schema.primary_time()
    if time:
        s = target.split_advice(d, time, grain).first()
        lines += ["", "## Split", "", f"Train before {s['cutoff']:%Y-%m-%d} ({s['before']:,} rows), test from then on ({s['after']:,} rows)."]
    return "\n".join(lines)
