"""Histogram sort into shards of equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, slots

SHARDS, OVERHEAD, TOLERANCE, PROBE_BITS = 40, 16, 0.002, 10
#: The sort key is two unsigned 63-bit numbers: the text's hash, then the id's and the row's (so copies of a text lie side by side).
KEY_BITS = 63


def keyed(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32 and the key; the text itself goes no further. To be written before it is used twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shift = lambda c: F.shiftrightunsigned(c, 1)
    # rows equal in text and id differ in the last 32 bits, so that they can be cut too
    second = F.shiftleft(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 31)), 32) + F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(9)), F.lit(1 << 32))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shift(F.xxhash64(F.col("text").isNull(), text)).alias("_k1"), second.alias("_k2"))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which shards 1, 2, ... begin: shard s has the keys from its splitter on.

    Each round counts, over all partitions, the exact bytes below probes that cut the intervals still in
    question, and keeps for each splitter the interval that holds its target. It ends when the bytes at a
    bound are within tolerance (of a shard's bytes) of the target; a text whose copies are more than that
    is cut by the second part of the key. What comes to the driver is at most shards * 2**PROBE_BITS counts
    a round, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    goal = {s: total * s / shards for s in range(1, shards)}
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    # open intervals: (part of the key, fixed k1, low, bits) -> bytes below it
    open_ = {s: (0, 0, 0, KEY_BITS, 0) for s in goal} if total else {}
    while open_:
        areas = sorted({(part, k1, low, bits, below) for part, k1, low, bits, below in open_.values()})
        counted: dict[tuple, dict[int, int]] = {a: {} for a in areas}
        for part in (0, 1):
            mine = [a for a in areas if a[0] == part]
            if not mine:
                continue
            step = max(0, mine[0][3] - PROBE_BITS)
            names = {(a[1], a[2] >> a[3]) if part else a[2] >> a[3]: a for a in mine}
            k = F.col("_k2" if part else "_k1")
            if part:
                rows = keys.where(F.col("_k1").isin(sorted({a[1] for a in mine})))
                rows = rows.groupBy("_k1", F.shiftright(k, step).alias("_p")).agg(F.sum("size").alias("n"))
            else:
                top = F.shiftright(k, mine[0][3]) if mine[0][3] < KEY_BITS else F.lit(0).cast("long")
                rows = keys.where(top.isin(sorted(names))) if mine[0][3] < KEY_BITS else keys
                rows = rows.groupBy(F.lit(0).cast("long").alias("_k1"), F.shiftright(k, step).alias("_p")).agg(F.sum("size").alias("n"))
            for k1, p, n in rows.collect():
                low = p << step
                name = (k1, low >> mine[0][3]) if part else low >> mine[0][3]
                if name in names:
                    counted[names[name]][low] = n
        again = {}
        for s, area in open_.items():
            part, k1, _, bits, below = area
            step, at = max(0, bits - PROBE_BITS), below
            for low, n in sorted(counted[area].items()):
                if at + n >= goal[s]:
                    near, bound = min((abs(goal[s] - at), low), (abs(at + n - goal[s]), low + (1 << step)))
                    if near <= slack or step == 0 and part == 1:
                        done[s] = (k1, bound) if part else (bound, 0)
                    else:
                        again[s] = (part, k1, low, step, at) if step else (1, low, 0, KEY_BITS, at)
                    break
                at += n
            else:
                done[s] = (k1, 1 << KEY_BITS) if part else (1 << KEY_BITS, 0)
        open_ = again
    return [done[s] for s in sorted(done)]


def shard(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) for every document.

    size is the text's UTF-8 bytes plus ``overhead``; a null text has no bytes and isn't equal to an empty
    one. Equal texts lie side by side and so share a shard, but for those that a bound has to cut. Slots
    run from 0 without gaps in each shard. Rows equal in text and doc_id lie side by side and may be cut as well. A
    text longer than a shard's share fills it alone, and its neighbours' shards are the smaller. A null doc_id is an id like
    others; further columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keys = Scratch(spark).keep(keyed(docs, overhead))
    bounds = splitters(keys, shards, tolerance)
    at = F.lit(0)
    for k1, k2 in bounds:  # a few dozen comparisons in generated code
        at = at + ((F.col("_k1") > k1) | ((F.col("_k1") == k1) & (F.col("_k2") >= k2))).cast("int") if k1 < 1 << KEY_BITS else at
    subs = max(4, slots(spark))
    d = keys.withColumn("shard", at).withColumn("_sub", F.pmod(F.xxhash64("_k1", "_k2", F.lit(3)), F.lit(subs)))
    count = d.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    count = count.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # the one exchange of the rows: to parts of shards, which are numbered on their own
    own = W.partitionBy("shard", "_sub").orderBy("_k1", "_k2", "size")
    d = d.withColumn("_in", F.row_number().over(own) - 1).join(count, ["shard", "_sub"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_in")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
