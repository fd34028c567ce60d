"""Goals in words: which pipeline they ask for, what it still needs, and running it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ravelin.operators import forecast, modeling, quality, relations, segments, target, why
from ravelin.operators.quality import DatasetSchema

from .nl import Parser, ask

# Words that point to a pipeline. The first group that holds most of a goal's words is taken.
PIPELINES = {
    "forecast": ("forecast", "predict next", "expect", "future", "next month", "next week", "next quarter", "projection"),
    "model": ("predict", "model", "likely", "probability", "risk", "classify", "score"),
    "segment": ("segment", "cluster", "group customers", "types of", "similar"),
    "anomaly": ("unusual", "anomal", "outlier", "strange", "stand out"),
    "why": ("why", "explain", "reason", "cause", "drop", "fell", "rose", "changed"),
    "kpi": ("kpi", "key figure", "dashboard", "metrics", "indicators"),
    "quality": ("quality", "missing", "duplicates", "clean", "problems with the data"),
    "explore": ("explore", "overview", "insight", "patterns", "interesting", "summary", "chart"),
}
GRAINS = {"day": "D", "week": "W", "month": "M", "quarter": "Q", "year": "Y"}


@dataclass(frozen=True)
class Goal:
    """A goal: the pipeline and its settings; ``missing`` names what it can't do without."""

    pipeline: str
    measure: str | None = None
    target: str | None = None
    key: str | None = None
    time: str | None = None
    group: str | None = None
    grain: str = "M"
    missing: tuple[str, ...] = ()
    notes: tuple[str, ...] = field(default=())


def interpret(text: str, parser: Parser) -> Goal:
    """The goal that a text states; columns are found as in questions, and what is lacking is completed or named."""
    low = text.lower()
    hits = {p: sum(bool(re.search(rf"\b{re.escape(w)}", low)) for w in words) for p, words in PIPELINES.items()}
    best = max(hits, key=lambda p: hits[p])
    if not hits[best]:
        return Goal("question")
    m = re.search(r"\b(?:by|per|for each|across)\s+([a-z_ ]+)", low)
    group = parser.column(m[1]) if m else None
    grain = next((g for w, g in GRAINS.items() if re.search(rf"\b{w}", low)), "M")
    goal = Goal(best, measure=parser._measure(low), group=group, grain=grain, time=parser.schema.primary_time())
    m = re.search(r"\b(?:predict|model|likely|probability of|risk of|classify)\s+(?:the |whether |if )?([a-z_ ]+)", low)
    return complete(replace(goal, target=parser.column(m[1]) if m else None), parser.schema, parser.df)


def complete(goal: Goal, schema: DatasetSchema, df: DataFrame) -> Goal:
    """Fills in what the table makes plain, and names what is missing."""
    ids, notes, missing = schema.named("identifier"), list(goal.notes), []
    if goal.pipeline in ("forecast", "why") and not goal.time:
        missing.append("a time column")
    if goal.pipeline in ("forecast", "why") and not goal.measure:
        notes.append("rows are counted, as no measure was named")
    if goal.pipeline == "model":
        if not goal.target:
            found = target.candidates(df, schema)
            goal = replace(goal, target=found[0][1] if found else None)
            notes += [f"the target is taken to be {goal.target}"] if goal.target else []
        if not goal.target:
            missing.append("a target")
    if goal.pipeline in ("model", "segment", "anomaly") and not goal.key:
        goal = replace(goal, key=ids[0] if ids else None)
        missing += [] if goal.key else ["a key"]
    if goal.pipeline in ("segment", "anomaly") and not schema.measures:
        missing.append("a measure")
    return replace(goal, missing=tuple(missing), notes=tuple(notes))


def suggestions(schema: DatasetSchema) -> list[str]:
    """Goals that a table is fit for."""
    out = ["Check the data quality", "Explore the data for patterns"]
    m = schema.measures[0] if schema.measures else None
    if schema.primary_time():
        out += [f"Forecast {m} for the next months" if m else "Forecast the number of rows", f"Why did {m} change" if m else "Why did the number of rows change"]
    if schema.named("identifier") and m:
        out += ["Segment by their measures", "Find unusual rows"]
    if schema.named("binary"):
        out.append(f"Predict {schema.named('binary')[0]}")
    return out


def run(goal: Goal, df: DataFrame, schema: DatasetSchema, text: str = "") -> DataFrame:
    """The result of a goal as a table; a goal that lacks something is refused."""
    if goal.missing:
        raise ValueError("missing: " + ", ".join(goal.missing))
    how = "sum" if goal.measure else "count"
    if goal.pipeline == "quality":
        return quality.findings(df)
    if goal.pipeline == "explore":
        return relations.insights(df, schema.measures, [c.name for c in schema.columns if c.role in ("dimension", "binary") and not c.high_cardinality], schema.primary_time())
    if goal.pipeline == "kpi":
        from ravelin.operators import kpi

        roles, kpis = kpi.parse(kpi.starter({"table": df}))
        return kpi.evaluate({"table": df}, roles, kpis, goal.grain)
    if goal.pipeline == "forecast":
        series = forecast.build_series(df, goal.time, goal.grain, how, goal.measure, goal.group)
        errors = forecast.backtest(series, goal.grain).groupBy("model").agg(F.avg("mase").alias("mase")).orderBy("mase", "model").first()
        return forecast.forecast(series, goal.grain, errors["model"] if errors else "naive")
    if goal.pipeline == "why":
        from ravelin.functions.periods import bucket, complete_periods

        d = complete_periods(df, goal.time, goal.grain)
        last = [str(r[0]) for r in d.select(bucket(goal.time, goal.grain).alias("p")).distinct().orderBy(F.desc("p")).limit(2).collect()]
        dims = [c.name for c in schema.columns if c.role in ("dimension", "binary") and not c.high_cardinality]
        return why.breakdown(d, goal.time, goal.grain, last[-1], last[0], how, goal.measure, dims)
    if goal.pipeline == "segment":
        units = segments.units(df, goal.key, schema.measures)
        return segments.cluster(units, ["records", *schema.measures])[0]
    if goal.pipeline == "anomaly":
        return segments.isolation_forest(segments.units(df, goal.key, schema.measures), schema.measures, goal.key).orderBy(F.desc("anomaly"), goal.key)
    if goal.pipeline == "model":
        y = target.positive(df, goal.target)
        spec = modeling.ModelGoal("_target", goal.key, [m for m in schema.measures if m != goal.target], [c.name for c in schema.columns if c.role in ("dimension", "binary") and not c.high_cardinality and c.name != goal.target])
        d = df.withColumn("_target", y)
        model, _ = modeling.build(d, spec, ("logistic",))
        return modeling.scored(model, modeling.prepared(d, spec), spec)
    q, result = ask(df, text)
    if result is None:
        raise ValueError("could not place: " + ", ".join(q.unresolved))
    return result


def overview(df: DataFrame, schema: DatasetSchema) -> list[str]:
    """A few sentences on a table, with figures from the data alone."""
    r = f"The table has {schema.rows:,} rows and {len(schema.columns)} columns."
    out = [r, f"Measures: {', '.join(schema.measures) or 'none'}."]
    time = schema.primary_time()
    if time:
        a, b = df.agg(F.min(time), F.max(time)).first()
        out.append(f"It runs from {a:%Y-%m-%d} to {b:%Y-%m-%d}.")
    gaps = [c.name for c in schema.columns if c.missing > 0]
    out.append(f"Columns with missing values: {', '.join(gaps)}." if gaps else "No values are missing.")
    return out



