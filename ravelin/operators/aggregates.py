"""Aggregations of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ravelin.functions.periods import bucket
from ravelin.functions.stats import mean0, total

#: Names of the aggregations that charts and plans may ask for.
AGGREGATIONS = {
    "count": lambda c: F.count(c) if c is not None else F.count(F.lit(1)),
    "count_distinct": lambda c: F.count_distinct(c),
    "sum": lambda c: total(c),
    "average": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.median(c),
    "sum_distinct": lambda c: F.sum_distinct(c),
    "average_distinct": lambda c: F.expr(f"avg(distinct `{c}`)"),
    "min_distinct": lambda c: F.min(c),
    "max_distinct": lambda c: F.max(c),
    "mode": lambda c: F.expr(f"mode(`{c}`, true)"),
}


def aggregate(name: str, column: str | None) -> Column:
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {name!r}")
    return AGGREGATIONS[name](column)


def scalar(df: DataFrame, how: str, column: str | None, alias: str = "value") -> DataFrame:
    """One row with one aggregate; an average over no values is 0, as a sum is."""
    return df.agg((mean0(column) if how == "average" else aggregate(how, column)).alias(alias))


def grouped(df: DataFrame, by: str | list[str], how: str, column: str | None, alias: str = "value", keep_nulls: bool = True) -> DataFrame:
    """One row for each group (null is one unless ``keep_nulls`` is off)."""
    by = [by] if isinstance(by, str) else by
    return (df if keep_nulls else df.na.drop(subset=by)).groupBy(*by).agg(aggregate(how, column).alias(alias))


def extreme_rows(df: DataFrame, column: str, subject: str | None = None, highest: bool = True) -> DataFrame:
    """The rows (or subjects) that hold the highest or lowest value, all ties.

    The extreme is one number from a map-side aggregate, broadcast; the table is not sorted or brought together.
    """
    edge = df.agg((F.max if highest else F.min)(column).alias("_edge"))
    d = df.join(F.broadcast(edge), F.col(column) == F.col("_edge")).drop("_edge")
    return d.select(subject, column).distinct() if subject else d


def ranked_groups(df: DataFrame, subject: str, column: str, n: int, highest: bool = True, alias: str | None = None) -> DataFrame:
    """The n groups with the highest (lowest) sums; ties by name. One partial aggregate and a top-k."""
    if n <= 0:
        raise ValueError("the number of groups must be positive")
    alias = alias or column
    d = df.groupBy(subject).agg(total(column).alias(alias))
    return d.orderBy(F.desc(alias) if highest else F.asc(alias), F.asc_nulls_last(subject)).limit(n)


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a measure, exact."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).cast("double").alias("min"), q.alias("_q"), F.max(column).cast("double").alias("max"))
    return d.select("count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


def by_dimension(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """count, sum, mean, median, min, max and standard deviation of a measure in each group; no null group."""
    return df.na.drop(subset=[dimension]).groupBy(dimension).agg(
        F.count(measure).alias("count"), total(measure).alias("sum"), F.avg(measure).alias("mean"), F.median(measure).alias("median"), F.min(measure).cast("double").alias("min"), F.max(measure).cast("double").alias("max"), F.stddev(measure).alias("std")
    )


def by_period(df: DataFrame, time: str, grain: str, measure: str) -> DataFrame:
    """count, sum and mean of a measure in each calendar bucket."""
    return df.na.drop(subset=[time]).groupBy(bucket(time, grain).alias("period")).agg(F.count(measure).alias("count"), total(measure).alias("sum"), F.avg(measure).alias("mean"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value."""
    d = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return d.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def fold_rare(df: DataFrame, column: str, least: int = 20, other: str = "Other") -> DataFrame:
    """Values held by fewer than ``least`` rows become ``other``; counts are joined, and broadcast when Spark finds them small."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    big = n.where(F.col("_n") >= least).select(F.col(column).alias("_big"))
    return df.join(big, F.col(column).eqNullSafe(F.col("_big")), "left").withColumn(column, F.when(F.col("_big").isNotNull(), F.col(column)).otherwise(F.lit(other))).drop("_big")


def keep_top(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """All but the n most frequent values become ``other``."""
    top = F.broadcast(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(F.col(column).alias("_top")))
    return df.join(top, F.col(column).eqNullSafe(F.col("_top")), "left").withColumn(column, F.when(F.col("_top").isNotNull(), F.col(column)).otherwise(F.lit(other))).drop("_top")


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, rows): the contingency table in long form."""
    return df.na.drop(subset=[x, y]).groupBy(x, y).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, and those that repeat an earlier one in all columns (nulls equal)."""
    d = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return d.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def entities(df: DataFrame, entity: str, most: int = 4, longest: float = 40.0) -> DataFrame:
    """Distinct entities with up to ``most`` text attributes that each entity has one value of.

    Whether a column is such an attribute is found in one pass for all columns.
    """
    texts = [n for n, t in df.dtypes if t == "string" and n != entity]
    if not texts:
        return df.select(entity).na.drop().distinct()
    each = df.na.drop(subset=[entity]).groupBy(entity).agg(*[F.min(t).alias(f"lo_{t}") for t in texts], *[F.max(t).alias(f"hi_{t}") for t in texts])
    facts = each.agg(*[F.max((F.col(f"lo_{t}") != F.col(f"hi_{t}")).cast("int")).alias(f"v_{t}") for t in texts], *[F.count_distinct(f"lo_{t}").alias(f"d_{t}") for t in texts], *[F.avg(F.length(f"lo_{t}")).alias(f"l_{t}") for t in texts]).first()
    from ravelin.functions.names import name_tokens

    words = set(name_tokens(entity)) - {"id", "key", "code"}
    fits = [t for t in texts if not facts[f"v_{t}"] and facts[f"d_{t}"] > 1 and (facts[f"l_{t}"] or 0) <= longest]
    fits.sort(key=lambda t: (not words & set(name_tokens(t)), -facts[f"d_{t}"], t))
    return each.select(entity, *[F.col(f"lo_{t}").alias(t) for t in fits[:most]])
