"""How columns go together: correlation, group differences, association, trends; and insights ranked from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.functions.periods import bucket
from ravelin.functions.stats import chi_square, spearman

STRENGTHS = ((0.7, "strong"), (0.5, "moderate"), (0.3, "weak"))


def strength(r: float | None) -> str:
    return next((name for least, name in STRENGTHS if r is not None and abs(r) >= least), "none")


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, pearson) of all pairs of columns, pairwise complete, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        parts.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(x).alias("n"), F.corr(x, y).alias("pearson")).alias(f"p{i}"))
    return df.agg(*parts).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def eta_squared(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(groups, n, eta_squared, f): the share of a measure's variance that lies between groups.

    The sums of each group add up to those of the whole, so one grouped aggregate is all that touches the rows.
    """
    x = F.col(measure).cast("double")
    g = df.na.drop(subset=[group, measure]).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select("groups", "n", F.try_divide(between, between + F.col("within")).alias("eta_squared"), F.try_divide(between / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups"))).alias("f"))


def association(df: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """(chi-square, p, Cramer's V) of two columns of few values; only their crosstab comes to the driver."""
    rows = df.na.drop(subset=[x, y]).groupBy(x, y).count().collect()
    xs, ys = (sorted({r[k] for r in rows}, key=str) for k in (0, 1))
    table = np.zeros((len(xs), len(ys)))
    for r in rows:
        table[xs.index(r[0]), ys.index(r[1])] = r[2]
    return chi_square(table) if table.size else (0.0, 1.0, 0.0)


def chi_square_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, chi_square, cramers_v): the statistic without correction, in Spark."""
    c = df.na.drop(subset=[x, y]).groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rx, ry, all_ = W.partitionBy(x), W.partitionBy(y), W.partitionBy()
    c = c.withColumns({"rx": F.sum("o").over(rx), "ry": F.sum("o").over(ry), "t": F.sum("o").over(all_)}).withColumn("e", F.col("rx") * F.col("ry") / F.col("t"))
    # cells without rows add their expectation, which is what the seen cells lack of the total
    d = c.agg(F.max("t").cast("long").alias("n"), (F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")) + F.max("t") - F.sum("e")).alias("chi_square"), F.least(F.count_distinct(x), F.count_distinct(y)).alias("k"))
    return d.select("n", "chi_square", F.sqrt(F.try_divide("chi_square", F.col("n") * (F.col("k") - 1))).alias("cramers_v"))


def group_difference(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(highest, high, lowest, low, spread): the groups with the highest and lowest mean, and the gap as a share of the larger."""
    g = df.na.drop(subset=[group, measure]).groupBy(group).agg(F.avg(measure).alias("m"))
    d = g.agg(F.max_by(group, F.struct(F.col("m"), group)).alias("highest"), F.max("m").alias("high"), F.min_by(group, F.struct("m", group)).alias("lowest"), F.min("m").alias("low"))
    return d.withColumn("spread", F.coalesce(F.try_divide(F.abs(F.col("high") - F.col("low")), F.greatest(F.abs("high"), F.abs("low"))), F.lit(0.0)))


def trend(df: DataFrame, time: str, measure: str, grain: str = "M", how: str = "avg") -> DataFrame:
    """(periods, slope, r2, mean, change): the straight line through the means of periods; change over the whole span."""
    g = df.na.drop(subset=[time, measure]).groupBy(bucket(time, grain).alias("p")).agg(getattr(F, how)(measure).alias("y"))
    g = g.withColumn("i", (F.row_number().over(W.orderBy("p")) - 1).cast("double"))
    d = g.agg(F.count(F.lit(1)).alias("periods"), F.regr_slope("y", "i").alias("slope"), F.regr_r2("y", "i").alias("r2"), F.avg("y").alias("mean"), F.avg(F.abs("y")).alias("_a"))
    return d.withColumn("change", F.try_divide(F.col("slope") * (F.col("periods") - 1), F.col("_a"))).drop("_a")


def partners(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column: (column, vif); infinite for one that the others determine."""
    rows = pearson_matrix(df.na.drop(subset=columns), columns).collect()
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in rows:
        m[at[r["x"]], at[r["y"]]] = m[at[r["y"]], at[r["x"]]] = r["pearson"] or 0.0
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i]
        r2 = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i]) if rest else 0.0
        out.append((c, float("inf") if r2 >= 0.9999 else 1 / (1 - r2)))
    return df.sparkSession.createDataFrame(out, "column string, vif double")


def insights(df: DataFrame, measures: list[str], dimensions: list[str], time: str | None = None, n: int = 10) -> DataFrame:
    """(kind, columns, score, text): the strongest patterns between columns, best first.

    Scores: |r| of a pair of measures * 100; the gap d between groups as 100 d / (1 + d); for a trend 60 % slope and 40 %
    fit. A pair that shares a column with a better correlated one (|r| of .85 or more between them) isn't told twice.
    """
    out: list[tuple[str, str, float, str]] = []
    close: set[frozenset] = set()
    if len(measures) > 1:
        for r in pearson_matrix(df, measures).collect():
            rho = spearman(df, r["x"], r["y"]).first()["spearman"]
            best = max((r["pearson"], rho), key=lambda v: abs(v or 0.0)) or 0.0
            if abs(best) >= 0.85:
                close.add(frozenset((r["x"], r["y"])))
            if strength(best) != "none":
                out.append(("correlation", f"{r['x']}, {r['y']}", 100 * abs(best), f"{r['x']} and {r['y']} move {'together' if best > 0 else 'against each other'} ({strength(best)}, r = {best:.2f})."))
    for g in dimensions:
        for m in measures:
            r = group_difference(df, g, m).first()
            if r["highest"] is not None and r["spread"] > 0:
                out.append(("difference", f"{g}, {m}", 100 * r["spread"] / (1 + r["spread"]), f"{m} is highest for {g} {r['highest']} and lowest for {r['lowest']}."))
    for m in measures if time else []:
        r = trend(df, time, m).first()
        if r["periods"] and r["periods"] > 2 and r["mean"]:
            slope = abs(r["slope"] or 0.0) / abs(r["mean"])
            if (r["r2"] or 0) >= 0.5 and slope >= 0.01:
                out.append(("trend", f"{time}, {m}", 0.6 * min(100 * slope, 100) + 40 * r["r2"], f"{m} {'rises' if r['slope'] > 0 else 'falls'} over time."))
    out.sort(key=lambda x: (-x[2], x[1]))
    kept, seen = [], set()
    for x in out:
        twins = {y.replace(b, a) for pair in close for a, b in (sorted(pair), sorted(pair, reverse=True)) for y in (x[1],)}
        if not twins & seen - {x[1]}:
            kept.append(x)
            seen.add(x[1])
    return df.sparkSession.createDataFrame(kept[:n], "kind string, columns string, score double, text string")


def ratios(df: DataFrame, columns: list[str], most: float = 0.05, least_rows: int = 10) -> DataFrame:
    """(rate, numerator, denominator, error): columns that are the ratio of two others, so that one pattern isn't told thrice.

    All triples are tried by one aggregate.
    """
    triples = [(r, n, d) for r in columns for n in columns for d in columns if len({r, n, d}) == 3]
    parts = []
    for i, (r, n, d) in enumerate(triples):
        ratio = F.try_divide(F.col(n).cast("double"), F.when(F.col(d) != 0, F.col(d).cast("double")))
        error = F.try_divide(F.abs(F.col(r) - ratio), F.when(ratio != 0, F.abs(ratio)))
        parts.append(F.struct(F.lit(r).alias("rate"), F.lit(n).alias("numerator"), F.lit(d).alias("denominator"), F.avg(error).alias("error"), F.count(error).alias("rows")).alias(f"t{i}"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rate string, numerator string, denominator string, error double")
    out = df.agg(*parts).select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(triples))])).alias("t")).select("t.*")
    return out.where((F.col("error") <= most) & (F.col("rows") >= least_rows)).drop("rows")
