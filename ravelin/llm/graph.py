"""Connected components of a distributed graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, released


#: Steps along the pointers that a round takes; hashes rarely fall more often in a row along neighbours.
STEPS = 4
#: Edges (16 bytes each) that one task joins by itself; more are dealt over all tasks, in rounds, until no more than these are left.
LOCAL = 1 << 18


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while len(x):  # of two roots that an edge joins, the greater points to the least that it meets; ends of edges move to roots
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[up]


def joined(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), of which there are few enough for one task."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, labels = least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(released(run), "node long, label long")


def components(edges: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b longs): label is the least node of the component.

    Nodes go by their hash (of 64 bits and one to one), so an order of ids makes no long chains. In each round a node points to its neighbour of
    the least hash if that is less, ends of edges move along a few pointers, and edges whose ends meet go. So each round has far
    fewer edges. Once at most ``local`` edges are left, whatever the input, one task joins them at once: a round is some ten stages, the plans
    and tasks of which the driver must hold. All is written to the shared folder, two tables a round; nothing but a count comes to the driver.
    """

    def moved(d: DataFrame, column: str, up: DataFrame) -> DataFrame:
        """d with column moved along its pointer in up; nodes without one stay."""
        d = d.join(up.select(F.col("node").alias(column), F.col("up").alias("_to")), column, "left")
        return d.withColumn(column, F.coalesce("_to", column)).drop("_to")

    first = scratch.keep(edges.where("a != b").select("a", "b").distinct())
    n = first.count()
    if n <= local:
        labels = scratch.keep(joined(first))
        scratch.drop(first)
        return labels
    live, ups = first.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), []
    while n > local:
        live = live.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))
        near = live.groupBy("node").agg(F.min("low").alias("up"))
        up = near
        for _ in range(STEPS - 1):
            up = moved(up, "up", near)
        ups.append(scratch.keep(up.select("node", "up")))
        rest = moved(moved(live, "node", ups[-1]), "low", ups[-1])
        rest = scratch.keep(rest.where("node != low").select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b")).distinct())
        if len(ups) > 1:
            scratch.drop(before)
        live = before = rest
        n = live.count()
    if n:
        ups.append(scratch.keep(joined(live).withColumnRenamed("label", "up")))
    named = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.xxhash64("node"))
    for up in ups:
        named = moved(named, "root", up)
    least = named.groupBy("root").agg(F.min("node").alias("label"))
    labels = scratch.keep(named.join(least, "root").select("node", "label"))
    for done in (first, *ups, before):
        scratch.drop(done)
    return labels
