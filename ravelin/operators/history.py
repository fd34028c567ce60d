"""History of an item before each of its rows, and as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.functions.periods import floor_days
from ravelin.functions.stats import preceding


def history_features(df: DataFrame, item: str, time: str, row_id: str, success, days: int = 90) -> DataFrame:
    """Adds what was known of the item before each row; ``success`` is a boolean column.

    One shuffle on the item serves all windows. Rows of one moment are ordered by ``row_id``: earlier ones are history of
    later ones. The count of the last days takes rows from exactly ``days`` before on.
    """
    w = W.partitionBy(item).orderBy(time, row_id)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    recent = W.partitionBy(item).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    # rows of the same moment are in the range; those that come later by row_id aren't history
    peers = W.partitionBy(item, time)
    d = df.withColumn("_s", F.coalesce(success, F.lit(False)).cast("int"))
    after = F.count(F.lit(1)).over(peers) - F.row_number().over(W.partitionBy(item, time).orderBy(row_id))
    d = d.withColumns({
        "days_since_last": floor_days(F.col(time), F.lag(time).over(w)),
        "prior_contacts": (F.row_number().over(w) - 1).cast("long"),
        "prior_successes": F.coalesce(F.sum("_s").over(past), F.lit(0)).cast("long"),
        "last_succeeded": F.lag("_s").over(w),
        "days_since_success": floor_days(F.col(time), F.last(F.when(F.col("_s") == 1, F.col(time)), ignorenulls=True).over(past)),
        f"contacts_{days}d": (F.count(F.lit(1)).over(recent) - 1 - after).cast("long"),
    })
    return d.withColumn("prior_success_rate", F.expr("try_divide(prior_successes, prior_contacts)")).drop("_s")


def snapshot(df: DataFrame, item: str, time: str, row_id: str, success, as_of, items: DataFrame | None = None) -> DataFrame:
    """One row an item with its history strictly before ``as_of``; items without any are kept if ``items`` is given."""
    at = F.lit(as_of).cast("timestamp_ntz")
    d = df.where(F.col(time) < at).withColumn("_s", F.coalesce(success, F.lit(False)).cast("int"))
    out = d.groupBy(item).agg(
        F.count(F.lit(1)).alias("contacts"), F.sum("_s").cast("long").alias("successes"), F.max(time).alias("_last"), F.max(F.when(F.col("_s") == 1, F.col(time))).alias("_won"),
        F.max_by("_s", F.struct(time, row_id)).alias("last_succeeded"),
    )
    if items is not None:
        out = items.select(item).distinct().join(out, item, "left")
    return out.select(
        item, F.coalesce("contacts", F.lit(0)).cast("long").alias("contacts"), F.coalesce("successes", F.lit(0)).cast("long").alias("successes"), F.expr("try_divide(successes, contacts)").alias("success_rate"),
        floor_days(at, F.col("_last")).alias("days_since_last"), floor_days(at, F.col("_won")).alias("days_since_success"), "last_succeeded",
    )


def thirds(df: DataFrame, column: str, key: str, alias: str = "band") -> DataFrame:
    """Splits rows into low, middle and high third by rank (first come first at ties, by key): 0, 1, 2.

    The cut is at positions 1 + (n - 1) / 3 and 1 + 2 (n - 1) / 3, as interpolated quantiles of the ranks give it.
    """
    n = F.col("_n")
    d = preceding(df, column, F.col(column).isNotNull().cast("long"), "_r", (F.asc(key),)).join(F.broadcast(df.agg(F.count(column).alias("_n"))))
    r = F.col("_r") + 1
    band = F.when(r <= 1 + (n - 1) / 3, 0).when(r <= 1 + 2 * (n - 1) / 3, 1).otherwise(2)
    return d.withColumn(alias, F.when(F.col(column).isNotNull(), band)).drop("_r", "_n")


def quartile_bins(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """(bin, low, high, rows, mean): the outcome in the quartiles of a column; equal edges fall together.

    Edges are four numbers from one aggregate; rows then meet them in a broadcast, not in a sort.
    """
    d = df.select(column, outcome).na.drop()
    edges = d.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))).alias("_e"))
    d = d.join(F.broadcast(edges))
    bin_ = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(column))))
    d = d.withColumn("bin", bin_.cast("int"))
    return d.groupBy("bin").agg(F.element_at(F.first("_e"), F.first("bin")).alias("low"), F.element_at(F.first("_e"), F.first("bin") + 1).alias("high"), F.count(F.lit(1)).alias("rows"), F.avg(outcome).alias("mean"))


def ranked(scores: DataFrame, score: str, key: str) -> DataFrame:
    """Adds ``position`` (from 1, best first) over a whole table by bucketed counts: no single sorting task.

    Scores are dealt into ranges by a range partitioning; each range is numbered on its own and shifted by the rows before.
    """
    from pyspark.sql.functions import spark_partition_id

    d = scores.repartitionByRange(F.desc(score), F.asc(key)).withColumn("_part", spark_partition_id())
    d = d.sortWithinPartitions(F.desc(score), F.asc(key))
    n = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("_part").orderBy(F.desc(score), F.asc(key)))
    return d.withColumn("_own", own).join(F.broadcast(n.select("_part", "_before")), "_part").withColumn("position", (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def lift_table(df: DataFrame, score: str, label: str, key: str, groups: int = 10) -> DataFrame:
    """(decile, rows, positives, rate, lift, capture): cumulative capture of positives by groups of falling score."""
    d = df.select(score, label, key)
    d = preceding(d, score, F.lit(1), "_r", (F.asc(key),), falling=True).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("_n"))))
    d = d.withColumn("decile", (F.floor(F.col("_r") * groups / F.col("_n")) + 1).cast("long"))
    g = d.groupBy("decile").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"))
    all_ = W.partitionBy()
    rate = F.col("positives") / F.col("rows")
    base = F.sum("positives").over(all_) / F.sum("rows").over(all_)
    upto = W.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)
    return g.select("decile", "rows", "positives", rate.alias("rate"), F.try_divide(rate, base).alias("lift"), F.try_divide(F.sum("positives").over(upto), F.sum("positives").over(all_)).alias("capture"))


def top_share(df: DataFrame, by, score: str, key: str, share: float) -> DataFrame:
    """The best rows of each group: ceil(share * rows) of them."""
    d = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(by)))
    return d.where(F.col("_r") <= F.ceil(F.col("_n") * F.lit(share))).drop("_r", "_n")


def mid_percentile(df: DataFrame, column: str) -> DataFrame:
    """Adds ``percentile``: share of rows below a value and half of those equal to it, from counts of distinct values."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    n = preceding(n, column, F.col("_n"), "_below").join(F.broadcast(df.agg(F.count(column).alias("_all"))))
    n = n.withColumn("percentile", (F.col("_below") + F.col("_n") / 2) / F.col("_all")).drop("_n", "_below", "_all")
    return df.join(n, column, "left")
