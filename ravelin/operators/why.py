"""Why a figure changed between two periods, and which groups need attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ravelin.functions.periods import bucket
from ravelin.functions.stats import total

MISSING = "(missing)"


def sides(df: DataFrame, time: str, grain: str, previous: str, current: str) -> DataFrame:
    """Rows of the two periods, marked; the periods are given by their starts. The time filter reaches the scan."""
    p = bucket(time, grain)
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (previous, current))
    return df.where((p == a) | (p == b)).withColumn("_now", p == b)


def value(how: str, measure: str | None, now: Column) -> Column:
    x = F.col(f"`{measure}`") if measure else F.lit(1)
    kept = F.when(now, x)
    return {"sum": total(kept), "count": F.count(kept).cast("double"), "average": F.avg(kept), "count_distinct": F.count_distinct(kept).cast("double")}[how]


def compare(df: DataFrame, time: str, grain: str, previous: str, current: str, how: str, measure: str | None = None) -> DataFrame:
    """(previous, current, change, change_pct) from one conditional aggregate."""
    d = sides(df, time, grain, previous, current).agg(value(how, measure, ~F.col("_now")).alias("previous"), value(how, measure, F.col("_now")).alias("current"))
    change = F.coalesce("current", F.lit(0.0)) - F.coalesce("previous", F.lit(0.0))
    return d.withColumn("change", change).withColumn("change_pct", F.try_divide("change", F.abs("previous")))


def breakdown(df: DataFrame, time: str, grain: str, previous: str, current: str, how: str, measure: str | None, dimensions: list[str]) -> DataFrame:
    """(dimension, group, previous, current, change, share): every group of every dimension, one pass for all.

    Rows are expanded to one for each dimension before a partial aggregate, so what is shuffled is groups. Missing labels are a group.
    """
    d = sides(df, time, grain, previous, current)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias("group")) for c in dimensions])).alias("g")
    cols = [F.col(f"`{measure}`")] if measure else []
    g = d.select("_now", *cols, pairs).groupBy("g.dimension", "g.group").agg(value(how, measure, ~F.col("_now")).alias("previous"), value(how, measure, F.col("_now")).alias("current"))
    g = g.withColumn("change", F.coalesce("current", F.lit(0.0)) - F.coalesce("previous", F.lit(0.0)))
    whole = F.sum("change").over(W.partitionBy("dimension"))
    return g.withColumn("share", F.coalesce(F.try_divide("change", F.when(whole != 0, whole)), F.lit(0.0)))


def concentration(parts: DataFrame) -> DataFrame:
    """(dimension, top, concentration): the largest change that goes with the total, over all movement; dimensions by it."""
    w = W.partitionBy("dimension")
    d = parts.withColumn("_t", F.sum("change").over(w)).withColumn("_m", F.sum(F.abs("change")).over(w))
    mine = F.when(F.signum("change") == F.signum("_t"), F.abs("change")).otherwise(0.0)
    d = d.withColumn("_c", mine)
    return d.groupBy("dimension").agg(F.max_by("group", F.struct("_c", "group")).alias("top"), F.coalesce(F.try_divide(F.max("_c"), F.max("_m")), F.lit(0.0)).alias("concentration")).orderBy(F.desc("concentration"), "dimension")


def mix_and_rate(df: DataFrame, time: str, grain: str, previous: str, current: str, measure: str, dimension: str) -> DataFrame:
    """(group, mix, rate): how far a changed mean stems from shifts between groups and from changes inside them."""
    d = sides(df, time, grain, previous, current)
    g = d.groupBy(F.coalesce(F.col(f"`{dimension}`").cast("string"), F.lit(MISSING)).alias("group")).agg(
        F.count(F.when(~F.col("_now"), F.lit(1))).alias("n0"), F.count(F.when(F.col("_now"), F.lit(1))).alias("n1"), F.avg(F.when(~F.col("_now"), F.col(measure))).alias("r0"), F.avg(F.when(F.col("_now"), F.col(measure))).alias("r1")
    )
    all_ = W.partitionBy()
    w0, w1 = F.coalesce(F.try_divide(F.col("n0"), F.sum("n0").over(all_)), F.lit(0.0)), F.coalesce(F.try_divide(F.col("n1"), F.sum("n1").over(all_)), F.lit(0.0))
    g = g.withColumns({"w0": w0, "w1": w1})
    return g.select("group", ((F.col("w1") - F.col("w0")) * F.coalesce("r0", "r1", F.lit(0.0))).alias("mix"), F.coalesce(F.col("w1") * (F.col("r1") - F.col("r0")), F.lit(0.0)).alias("rate"))


def drill_down(df: DataFrame, time: str, grain: str, previous: str, current: str, how: str, measure: str | None, dimensions: list[str], depth: int = 3, least: float = 0.25) -> list[tuple[str, str, float]]:
    """The path of (dimension, group, share of the level's change) that most of the change runs along, at most ``depth`` long."""
    path: list[tuple[str, str, float]] = []
    left = list(dimensions)
    while left and len(path) < depth:
        parts = breakdown(df, time, grain, previous, current, how, measure, left)
        best = concentration(parts).first()
        if best is None or best["concentration"] < least:
            break
        share = parts.where((F.col("dimension") == best["dimension"]) & (F.col("group") == best["top"])).first()["share"]
        path.append((best["dimension"], best["top"], share))
        df = df.where(F.coalesce(F.col(f"`{best['dimension']}`").cast("string"), F.lit(MISSING)) == best["top"])
        left.remove(best["dimension"])
    return path


def group_history(df: DataFrame, time: str, grain: str, group: str, how: str, measure: str | None) -> DataFrame:
    """(group, period, value): every group in every period that any has; sums and counts are 0 where a group has none."""
    g = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(MISSING)).alias("group")
    x = F.col(f"`{measure}`") if measure else F.lit(1)
    d = df.na.drop(subset=[time]).groupBy(g, bucket(time, grain).alias("period")).agg({"sum": total(x), "count": F.count(x).cast("double"), "average": F.avg(x)}[how].alias("value"))
    grid = d.select("group").distinct().join(F.broadcast(d.select("period").distinct()))  # periods are few
    out = grid.join(d, ["group", "period"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if how != "average" else out


def attention(history: DataFrame, bad: str = "down", periods: int = 12) -> DataFrame:
    """(group, before, now, change_pct, z, trend, share, score): groups by how far they went the bad way.

    z compares the last period with median and MAD (scaled) of those before; trend is the slope of the last six over their mean size.
    """
    sign = -1.0 if bad == "down" else 1.0
    w = W.partitionBy("group").orderBy("period")
    past = w.rowsBetween(-periods, -1)
    d = history.withColumn("before", F.lag("value").over(w)).withColumn("_past", F.collect_list("value").over(past)).withColumn("_six", F.collect_list("value").over(w.rowsBetween(-5, 0)))
    last = W.partitionBy()
    d = d.withColumn("_last", F.max("period").over(last)).where(F.col("period") == F.col("_last"))

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a).cast("double"))
    d = d.withColumn("_med", median(F.col("_past"))).withColumn("_mad", 1.4826 * median(F.transform("_past", lambda x: F.abs(x - F.col("_med")))))
    d = d.withColumn("_m", mean(F.col("_past"))).withColumn("_sd", F.sqrt(mean(F.transform("_past", lambda x: (x - F.col("_m")) * (x - F.col("_m"))))))
    d = d.withColumn("z", F.try_divide(F.col("value") - F.col("_med"), F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.when(F.col("_sd") > 0, F.col("_sd")))))
    n = F.size("_six").cast("double")
    xbar = (n - 1) / 2
    slope = F.try_divide(F.aggregate(F.transform("_six", lambda y, i: (i - xbar) * y), F.lit(0.0), lambda a, b: a + b), n * (n * n - 1) / 12)
    size = mean(F.transform("_six", lambda x: F.abs(x)))
    d = d.withColumn("trend", F.try_divide(slope, F.when(size != 0, size)))
    d = d.withColumn("change_pct", F.when(F.col("before") == 0, F.when(F.col("value") == 0, None).otherwise(F.signum("value"))).otherwise(F.try_divide(F.col("value") - F.col("before"), F.abs("before"))))
    d = d.withColumn("share", F.coalesce(F.try_divide(F.abs("value") + F.abs(F.coalesce("before", F.lit(0.0))), F.sum(F.abs("value") + F.abs(F.coalesce("before", F.lit(0.0)))).over(last)), F.lit(0.0))).withColumn("_k", F.count(F.lit(1)).over(last))
    way = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c) * sign, F.lit(0.0)))
    score = (40 * F.least(way("change_pct"), F.lit(1.0)) + 30 * F.least(way("z") / 4, F.lit(1.0)) + 20 * F.least(5 * way("trend"), F.lit(1.0))) * (0.5 + 0.5 * F.least(F.col("share") * F.col("_k"), F.lit(1.0))) + 10 * F.least(F.col("share"), F.lit(1.0))
    return d.select("group", "before", F.col("value").alias("now"), "change_pct", "z", "trend", "share", score.alias("score")).orderBy(F.desc("score"), "group")


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """(same): whether two columns name the same groups."""
    return df.na.drop(subset=[a, b]).agg(((F.count_distinct(a, b) == F.count_distinct(a)) & (F.count_distinct(a, b) == F.count_distinct(b))).alias("same"))
