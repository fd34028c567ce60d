"""Segments of units, bands, and rows that stand out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ravelin.functions.stats import adjusted_skewness

TREES, TREE_ROWS, TOP_SHARE = 200, 256, 0.01


def units(df: DataFrame, key: str, numbers: list[str], categories: list[str] = ()) -> DataFrame:
    """One row a unit: mean of each number, most frequent (then least) category, and ``records``."""
    return df.na.drop(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("records"), *[F.avg(c).alias(c) for c in numbers], *[F.expr(f"mode(`{c}`, true)").alias(c) for c in categories])


def prepared(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Numbers made comparable: gaps become the median, skewed counts their logarithm, all scaled to mean 0 and deviation 1."""
    r = df.agg(*[x for c in numbers for x in (F.median(c).alias(f"m_{c}"), F.min(c).alias(f"lo_{c}"), adjusted_skewness(c).alias(f"s_{c}"))]).first()
    d = df.na.fill({c: float(r[f"m_{c}"]) for c in numbers if r[f"m_{c}"] is not None})
    d = d.withColumns({c: F.log1p(c) if (r[f"s_{c}"] or 0) > 1 and (r[f"lo_{c}"] or 0) >= 0 else F.col(c).cast("double") for c in numbers})
    z = d.agg(*[x for c in numbers for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"d_{c}"))]).first()
    return d.withColumns({c: (F.col(c) - F.lit(z[f"a_{c}"])) / F.lit(z[f"d_{c}"] or 1.0) for c in numbers})


def cluster(df: DataFrame, numbers: list[str], k: int | None = None, most: int = 8, seed: int = 42) -> tuple[DataFrame, int]:
    """(rows with ``segment``, k): k-means on prepared numbers; k by the silhouette if it isn't given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    keep = df.columns
    d = prepared(df, numbers)
    d = VectorAssembler(inputCols=numbers, outputCol="_v").transform(d).persist()
    try:
        fits = {}
        for n in [k] if k else range(2, most + 1):
            model = KMeans(k=n, seed=seed, featuresCol="_v", predictionCol="segment").fit(d)
            score = ClusteringEvaluator(featuresCol="_v", predictionCol="segment").evaluate(model.transform(d)) if not k else 0.0
            fits[n] = (score, model)
        best = max(fits, key=lambda n: (fits[n][0], -n))
        out = fits[best][1].transform(d).select(*keep, "segment")
    finally:
        d.unpersist()
    return out, best


def segment_profile(df: DataFrame, segment: str, numbers: list[str]) -> DataFrame:
    """(segment, column, rows, mean, z, trait): how each segment differs from the whole; High or Low from half a deviation on."""
    whole = df.agg(*[x for c in numbers for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"d_{c}"))])
    g = df.groupBy(segment).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"m_{c}") for c in numbers]).join(F.broadcast(whole))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.try_divide(F.col(f"m_{c}") - F.col(f"a_{c}"), F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}"))).alias("z")) for c in numbers])).alias("c")
    d = g.select(segment, "rows", cells).select(segment, "rows", "c.column", "c.mean", "c.z")
    return d.withColumn("trait", F.when(F.col("z") >= 0.5, "High").when(F.col("z") <= -0.5, "Low").otherwise(""))


def robust_z(df: DataFrame, column: str) -> DataFrame:
    """Adds ``z``: distance from the median in scaled MADs (in deviations where the MAD is 0)."""
    mid = df.agg(F.median(column).alias("_med"), F.stddev_pop(column).alias("_sd"))
    d = df.join(F.broadcast(mid))
    mad = d.agg((1.4826 * F.median(F.abs(F.col(column) - F.col("_med")))).alias("_mad"))
    d = d.join(F.broadcast(mad))
    return d.withColumn("z", F.try_divide(F.col(column) - F.col("_med"), F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.when(F.col("_sd") > 0, F.col("_sd"))))).drop("_med", "_sd", "_mad")


def isolation_forest(df: DataFrame, numbers: list[str], key: str, trees: int = TREES, seed: int = 1) -> DataFrame:
    """Adds ``anomaly`` (0 to 1, higher stands out more): mean depth at which random cuts part a row from others.

    Trees grow on small samples on the driver; every row is scored, by Arrow batches.
    """
    d = prepared(df, numbers)
    n = d.count()
    want = trees * TREE_ROWS
    some = d.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 4 * TREE_ROWS * 8 / max(1, n)))).select(*numbers).limit(want)
    x = np.array([list(r) for r in some.collect()], float).reshape(-1, len(numbers))
    rng = np.random.default_rng(seed)

    def harmonic(m: int) -> float:
        return 0.0 if m <= 1 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def grow(rows: np.ndarray, depth: int):
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth == 0 or not len(spread):
            return harmonic(len(rows))
        j = rng.choice(spread)
        cut = rng.uniform(rows[:, j].min(), rows[:, j].max())
        left = rows[:, j] < cut
        return (int(j), float(cut), grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

    forest = [grow(x[rng.choice(len(x), min(TREE_ROWS, len(x)), replace=False)], 8) for _ in range(trees)] if len(x) else []
    norm = harmonic(min(TREE_ROWS, len(x))) or 1.0

    def depths(node, v: np.ndarray, at: np.ndarray, out: np.ndarray, depth: int) -> None:
        if not isinstance(node, tuple):
            out[at] += depth + node
            return
        j, cut, a, b = node
        left = v[at, j] < cut
        if left.any():
            depths(a, v, at[left], out, depth + 1)
        if not left.all():
            depths(b, v, at[~left], out, depth + 1)

    def run(batches):
        for pdf in batches:
            v, total = pdf[numbers].to_numpy(float), np.zeros(len(pdf))
            for t in forest:
                depths(t, v, np.arange(len(v)), total, 0)
            yield pd.DataFrame({key: pdf[key], "anomaly": 2 ** (-total / max(1, len(forest)) / norm)})

    return d.select(key, *numbers).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, anomaly double")


def plane(df: DataFrame, numbers: list[str], key: str) -> DataFrame:
    """(key, x, y): rows on the two main directions of their prepared numbers."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=numbers, outputCol="_v").transform(prepared(df, numbers))
    d = PCA(k=2, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn("_p", vector_to_array("_p"))
    return d.select(key, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def heatmap(df: DataFrame, segment: str, category: str) -> DataFrame:
    """(segment, category, rows, share): how a category's values fall on segments."""
    from pyspark.sql import Window as W

    d = df.na.drop(subset=[segment, category]).groupBy(segment, category).agg(F.count(F.lit(1)).alias("rows"))
    return d.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy(segment)))
