"""Event-time counterparts of the calendar buckets, for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling(stream: DataFrame, time: str, length: str, late: str, by: list[str], *aggregates) -> DataFrame:
    """Aggregates of fixed windows; rows later than ``late`` are left out, and closed windows leave the state.

    The watermark is the streaming form of the rule that a last period isn't told before it is complete.
    """
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    d = d.groupBy(F.window(time, length).alias("_w"), *by).agg(*aggregates)
    return d.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *[c for c in d.columns if c not in ("_w", *by)])


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str], *aggregates) -> DataFrame:
    """Aggregates of sessions that a gap ends."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    d = d.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*aggregates)
    return d.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *[c for c in d.columns if c not in ("_w", *by)])


def deduplicated(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def enriched(stream: DataFrame, lookup: DataFrame, key: str, lookup_key: str) -> DataFrame:
    """A stream with the columns of a static table; Spark broadcasts the table if it is small."""
    names = [c for c in lookup.columns if c != lookup_key and c not in stream.columns]
    there = lookup.dropDuplicates([lookup_key]).select(F.col(lookup_key).alias("_key"), *names)
    return stream.join(there, stream[key] == there["_key"], "left").drop("_key")
