"""Calendar buckets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

GRAINS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
STEPS = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}
SEASONS = {"D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1}
#: The last bucket counts as complete if this much of it is covered.
COMPLETE = 0.8


def bucket(column: Column | str, grain: str) -> Column:
    """The start of the day, week (Monday), month, quarter or year, without time zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_trunc(GRAINS[grain], c).cast("timestamp_ntz")


def suggest_grain(n_distinct: int, first: datetime | None, last: datetime | None) -> str | None:
    """The grain for a column: none for few distinct values, else by its span."""
    if n_distinct <= 60 or first is None or last is None:
        return None
    days = (last - first).days
    for most, grain in ((90, "D"), (730, "W"), (6 * 365, "M"), (20 * 365, "Q")):
        if days <= most:
            return grain
    return "Y"


def period_end(start: datetime, grain: str) -> datetime:
    """The first moment after a bucket."""
    if grain in "DW":
        return start + timedelta(days=1 if grain == "D" else 7)
    months = {"M": 1, "Q": 3, "Y": 12}[grain]
    m = start.month - 1 + months
    return start.replace(year=start.year + m // 12, month=m % 12 + 1)


def last_is_complete(start: datetime, newest: datetime | date, grain: str, least: float = COMPLETE) -> bool:
    """Whether the data cover enough of the bucket that starts at ``start``."""
    length = (period_end(start, grain) - start).days
    return ((newest.date() if isinstance(newest, datetime) else newest) - start.date()).days + 1 >= least * length


def complete_periods(df: DataFrame, column: str, grain: str, least: float = COMPLETE) -> DataFrame:
    """Rows of ``df`` without those of a last bucket that is hardly begun."""
    newest = df.agg(F.max(column)).first()[0]
    if newest is None:
        return df
    start = df.sparkSession.range(1).select(bucket(F.lit(newest), grain).alias("s")).first()[0]
    return df if last_is_complete(start, newest, grain, least) else df.where(F.col(column) < F.lit(start))


def calendar(df: DataFrame, column: str, grain: str) -> DataFrame:
    """One row for each bucket between the first and the last, gaps too: (period)."""
    ends = df.agg(F.min(bucket(column, grain)).alias("a"), F.max(bucket(column, grain)).alias("b")).where("a is not null")
    return ends.select(F.explode(F.expr(f"sequence(a, b, {STEPS[grain]})")).alias("period"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two moments (elapsed time, rounded down)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")
