"""Models of a target: split, features, candidates, measures, scores, and their registry."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

MOST_LEVELS, RARE = 50, 0.01


@dataclass
class ModelGoal:
    """What to predict from what; time splits by moments, else rows are split by a hash of the key."""

    target: str
    key: str
    numbers: list[str]
    categories: list[str] = field(default_factory=list)
    time: str | None = None
    classify: bool = True


def time_split(df: DataFrame, time: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the moment that ``share`` of the distinct moments lie before."""
    moments = df.select(time).na.drop().distinct()
    n = moments.count()
    at = moments.withColumn("_i", F.row_number().over(W.orderBy(time))).where(F.col("_i") == max(1, -int(-n * share // 1)) + 1).first()
    cut = at[0] if at else moments.agg(F.max(time)).first()[0]
    return df.where(F.col(time) < F.lit(cut)), df.where(F.col(time) >= F.lit(cut))


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split by key that is the same in every run and on every cluster."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return df.where(u), df.where(~u)


def pipeline(goal: ModelGoal, name: str, df: DataFrame):
    """Feature stages and an estimator: median for gaps, rare levels pooled, one column a level."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    stages = [Imputer(strategy="median", inputCols=goal.numbers, outputCols=[f"{c}_filled" for c in goal.numbers])] if goal.numbers else []
    if goal.categories:
        stages += [StringIndexer(inputCols=goal.categories, outputCols=[f"{c}_at" for c in goal.categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_at" for c in goal.categories], outputCols=[f"{c}_on" for c in goal.categories])]
    stages.append(VectorAssembler(inputCols=[*(f"{c}_filled" for c in goal.numbers), *(f"{c}_on" for c in goal.categories)], outputCol="_raw", handleInvalid="keep"))
    linear = name in ("logistic", "ridge")
    if linear:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x"))
    x = "_x" if linear else "_raw"
    make = {
        "logistic": lambda: LogisticRegression(featuresCol=x, labelCol=goal.target, weightCol="_weight", regParam=1e-3),
        "ridge": lambda: LinearRegression(featuresCol=x, labelCol=goal.target, regParam=1.0, elasticNetParam=0.0),
        "forest": lambda: (RandomForestClassifier if goal.classify else RandomForestRegressor)(featuresCol=x, labelCol=goal.target, numTrees=50, minInstancesPerNode=5, seed=42),
        "boosting": lambda: (GBTClassifier if goal.classify else GBTRegressor)(featuresCol=x, labelCol=goal.target, maxIter=30, stepSize=0.1, seed=42),
    }
    return Pipeline(stages=[*stages, make[name]()])


def prepared(df: DataFrame, goal: ModelGoal) -> DataFrame:
    """Labelled rows, rare levels pooled, numbers as doubles, class weights that balance the outcomes."""
    d = df.where(F.col(goal.target).isNotNull()).withColumn(goal.target, F.col(goal.target).cast("double"))
    for c in goal.categories:
        n = d.groupBy(c).count()
        big = n.join(F.broadcast(n.agg(F.sum("count").alias("_t")))).where(F.col("count") >= RARE * F.col("_t")).select(F.col(c).alias("_big"))
        d = d.join(F.broadcast(big.limit(int(1 / RARE))), F.col(c) == F.col("_big"), "left").withColumn(c, F.coalesce("_big", F.lit("Other"))).drop("_big")
    d = d.withColumns({c: F.col(c).cast("double") for c in goal.numbers})
    if goal.classify:
        rate = d.agg(F.avg(goal.target)).first()[0] or 0.5
        d = d.withColumn("_weight", F.when(F.col(goal.target) == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9)))
    return d


def class_measures(df: DataFrame, score: str, label: str, share: float = 0.2) -> DataFrame:
    """(rows, positives, average_precision, roc_auc, brier, capture, lift) of scores, exact, from one sort by score.

    Ties count together, as steps of the curve.
    """
    n = df.groupBy(score).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).cast("double").alias("p"), F.sum((F.col(score) - F.col(label)) ** 2).alias("e"))
    down = W.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    n = n.withColumns({"upto": F.sum("n").over(down), "found": F.sum("p").over(down)})
    all_ = W.partitionBy()
    n = n.withColumns({"total": F.sum("n").over(all_), "good": F.sum("p").over(all_)})
    k = F.round(F.col("total") * share)
    before = F.col("upto") - F.col("n")
    part = F.greatest(F.lit(0.0), F.least(F.col("n"), k - before)) / F.col("n")
    d = n.agg(F.max("total").cast("long").alias("rows"), F.max("good").cast("long").alias("positives"), F.sum(F.col("p") / F.col("good") * F.col("found") / F.col("upto")).alias("average_precision"),
              F.sum((F.col("n") - F.col("p")) * (F.col("found") - F.col("p") / 2)).alias("_u"), (F.sum("e") / F.max("total")).alias("brier"), F.sum(part * F.col("p") / F.col("good")).alias("capture"))
    return d.select("rows", "positives", "average_precision", F.try_divide("_u", F.col("positives") * (F.col("rows") - F.col("positives"))).alias("roc_auc"), "brier", "capture", (F.col("capture") / share).alias("lift"))


def number_measures(df: DataFrame, score: str, label: str) -> DataFrame:
    """(rows, mae, rmse, r2)."""
    e = F.col(score) - F.col(label)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"))


def scored(model, df: DataFrame, goal: ModelGoal) -> DataFrame:
    """key, target, score (a probability for classes)."""
    from pyspark.ml.functions import vector_to_array

    d = model.transform(df)
    s = vector_to_array("probability")[1] if goal.classify else F.col("prediction")
    return d.select(goal.key, goal.target, s.alias("score"))


def build(df: DataFrame, goal: ModelGoal, names: tuple[str, ...] | None = None):
    """(model, report): candidates fitted and chosen on a validation part, told on a test part that no choice has seen."""
    names = names or (("logistic", "forest", "boosting") if goal.classify else ("ridge", "forest", "boosting"))
    d = prepared(df, goal)
    cut = (lambda x: time_split(x, goal.time)) if goal.time else (lambda x: hash_split(x, goal.key))
    rest, test = cut(d)
    train, valid = (lambda x: time_split(x, goal.time))(rest) if goal.time else hash_split(rest, goal.key, seed=43)
    measure = (lambda x: class_measures(x, "score", goal.target)) if goal.classify else (lambda x: number_measures(x, "score", goal.target))
    kept = train.persist()
    try:
        found = {n: measure(scored(pipeline(goal, n, kept).fit(kept), valid, goal)).first().asDict() for n in names}
    finally:
        kept.unpersist()
    best = max(names, key=lambda n: (found[n]["average_precision"] or 0.0) if goal.classify else -(found[n]["mae"] or 0.0))
    model = pipeline(goal, best, rest).fit(rest)
    return model, {"chosen": best, "validation": found, "test": measure(scored(model, test, goal)).first().asDict()}


def importance(model, df: DataFrame, goal: ModelGoal, seed: int = 1) -> DataFrame:
    """(column, loss): how much worse the scores get when a column's values are dealt to other rows.

    Each row gets the value of the row after it in an order by hash, inside 64 parts of the table.
    """
    d = prepared(df, goal)
    key = "average_precision" if goal.classify else "mae"
    measure = (lambda x: class_measures(x, "score", goal.target)) if goal.classify else (lambda x: number_measures(x, "score", goal.target))
    whole = measure(scored(model, d, goal)).first()[key] or 0.0
    rows = []
    for c in [*goal.numbers, *goal.categories]:
        part = F.pmod(F.xxhash64(goal.key, F.lit(c)), F.lit(64))
        mixed = d.withColumn(c, F.coalesce(F.lead(c).over(W.partitionBy(part).orderBy(F.xxhash64(goal.key, F.lit(seed)))), F.col(c)))
        got = measure(scored(model, mixed, goal)).first()[key] or 0.0
        rows.append((c, float(whole - got if goal.classify else got - whole)))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "column string, loss double")


def fingerprint(df: DataFrame) -> str:
    """Columns, rows and contents of a table in one value, whatever the order of its rows."""
    flat = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*flat).cast("decimal(38,0)"))).first()
    return f"{','.join(df.columns)}|{r[0]}|{r[1]}"


def save(model, goal: ModelGoal, report: dict, path: str) -> None:
    """A model and what is known of it, in a folder that Spark can write."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"goal": asdict(goal), "report": report}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str):
    from pyspark.ml import PipelineModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), ModelGoal(**meta["goal"]), meta["report"]


def row_reasons(df: DataFrame, goal: ModelGoal, most: int = 3) -> DataFrame:
    """(key, reasons): what sets a row apart in the direction that the outcome goes: numbers in the outer fifth, categories of other rates.

    Bounds and directions come from one aggregate each; rows meet them in a broadcast.
    """
    y = F.col(goal.target).cast("double")
    stats = df.agg(*[x for c in goal.numbers for x in (F.percentile(F.col(c).cast("double"), F.array(F.lit(0.2), F.lit(0.8))).alias(f"q_{c}"), F.corr(F.col(c).cast("double"), y).alias(f"r_{c}"))], F.avg(y).alias("_mean"))
    d = df.join(F.broadcast(stats))
    reasons = []
    for c in goal.numbers:
        high = F.col(c) >= F.when(F.col(f"r_{c}") > 0, F.col(f"q_{c}")[1])
        low = F.col(c) <= F.when(F.col(f"r_{c}") < 0, F.col(f"q_{c}")[0])
        reasons.append(F.when(high, F.struct(F.abs(f"r_{c}").alias("w"), F.lit(f"{c} is high").alias("t"))).when(low, F.struct(F.abs(f"r_{c}").alias("w"), F.lit(f"{c} is low").alias("t"))))
    for c in goal.categories:
        rate = df.groupBy(c).agg(F.avg(y).alias(f"p_{c}"))
        d = d.join(rate, c, "left")
        lift = F.try_divide(F.col(f"p_{c}"), F.when(F.col("_mean") != 0, F.col("_mean")))
        reasons.append(F.when(lift >= 1.15, F.struct((lift - 1).alias("w"), F.concat(F.lit(f"{c} is "), F.col(c).cast("string")).alias("t"))))
    ranked = F.sort_array(F.array_compact(F.array(*reasons)), asc=False)
    return d.select(goal.key, F.transform(F.slice(ranked, 1, most), lambda x: x["t"]).alias("reasons"))
