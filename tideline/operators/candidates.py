"""Candidate regressions of counts, walk-forward predictions, selection, and calibration, on Spark's own learners.

A fold trains on all seasons before its own. Every fit is a Spark job over the rows of its fold; the
driver holds coefficients, trees and one score a candidate. Boosted trees minimise squared error here (Spark's
learner has no Poisson loss), on the logarithm of the count, so that they, too, keep to positive means.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = ("dynamic", "poisson_all", "poisson_recent", "boosting_all", "boosting_recent", "residual_recent", "ensemble_all")

#: Added to counts before logarithms; half-life in days of recent weights; the least weight.
SHIFT, HALF_LIFE, LEAST = 0.75, 365.25 * 5, 0.12

#: The linear model's penalty; the trees' number, depth, rate and rows a leaf.
ALPHA, TREES, DEPTH, RATE, LEAF = 0.35, 170, 4, 0.045, 30


def time_weight(day: Column, reference: int) -> Column:
    """Half at five years before a reference day, 0.12 at least."""
    age = F.greatest(F.lit(reference) - day, F.lit(0))
    return F.greatest(F.lit(LEAST), F.least(F.lit(1.0), F.pow(F.lit(0.5), age / HALF_LIFE)))


def prepared(features: list[str], scaled: bool) -> list:
    """Stages that fill gaps with medians and gather the features; scaled ones for linear models."""
    filled = [f"__{f}" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw")]
    return [*stages, StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)] if scaled else stages


def boosted(label: str, trees: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="__raw", labelCol=label, weightCol="__w", predictionCol="__p", maxIter=trees, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=LEAF, seed=42)


def fitted(name: str, train: DataFrame, features: list[str], target: str, baseline: str, day: str, reference: int, trees: int = TREES):
    """A function from rows to rows with the column "predicted" by a candidate."""
    if name == "dynamic":
        return lambda rows: rows.withColumn("predicted", F.col(baseline))
    if name == "ensemble_all":
        parts = [fitted(n, train, features, target, baseline, day, reference, trees) for n in ("poisson_all", "boosting_all")]

        def both(rows: DataFrame) -> DataFrame:
            first = parts[0](rows).withColumnRenamed("predicted", "__first")
            return parts[1](first).withColumn("predicted", (F.col("predicted") + F.col("__first")) / 2).drop("__first")

        return both
    weight = time_weight(F.col(day), reference) if name.endswith("_recent") else F.lit(1.0)
    kind = name.split("_")[0]
    log = F.log(F.col(target) + SHIFT) - (F.log(F.col(baseline) + SHIFT) if kind == "residual" else 0.0)
    rows = train.withColumns({"__w": weight, "__y": F.col(target).cast("double") if kind == "poisson" else log})
    if kind == "poisson":
        last = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p", regParam=ALPHA, maxIter=50)
        model = Pipeline(stages=[*prepared(features, True), last]).fit(rows)
        value = F.col("__p")
    else:
        model = Pipeline(stages=[*prepared(features, False), boosted("__y", trees)]).fit(rows)
        value = F.exp(F.col("__p")) * (F.col(baseline) + SHIFT if kind == "residual" else F.lit(1.0)) - SHIFT

    def predict(new: DataFrame) -> DataFrame:
        return model.transform(new).withColumn("predicted", F.greatest(value, F.lit(0.01))).select(*new.columns, "predicted")

    return predict


def walk_forward(rows: DataFrame, features: list[str], target: str, baseline: str, season: str, day: str, names: tuple[str, ...] = CANDIDATES, first: int = 6, trees: int = TREES) -> DataFrame:
    """The rows of every season from the first-th on, with a column for each candidate fitted on all seasons before."""
    seasons = [r[0] for r in rows.select(season).distinct().orderBy(season).collect()]  # a handful
    out = None
    for at in range(first, len(seasons)):
        train, fold = rows.where(F.col(season) < seasons[at]), rows.where(F.col(season) == seasons[at])
        reference = fold.agg(F.min(day)).first()[0]
        for name in names:
            fold = fitted(name, train, features, target, baseline, day, reference, trees)(fold).withColumnRenamed("predicted", name)
        out = fold if out is None else out.unionByName(fold)
    return out


def scores(predicted: DataFrame, target: str, names: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """candidate, mae: one pass over walk-forward rows."""
    mae = F.array(*[F.struct(F.lit(n).alias("candidate"), F.avg(F.abs(F.col(n) - F.col(target))).alias("mae")) for n in names])
    return predicted.agg(mae.alias("m")).select(F.inline("m"))


def selected(predicted: DataFrame, target: str, season: str, names: tuple[str, ...] = CANDIDATES, locked: int = 2) -> str:
    """The candidate of the lowest error before the last seasons, which stay locked; of equals the first."""
    seasons = [r[0] for r in predicted.select(season).distinct().orderBy(season).collect()]
    open_ = predicted.where(F.col(season) < seasons[-locked]) if len(seasons) > locked else predicted
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("candidate"))
    return scores(open_, target, names).orderBy("mae", order).first()["candidate"]


def line_calibration(rows: DataFrame, p: str, won: str, strength: float = 0.5, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of a logistic regression of the outcome on the logit of p, by Newton's method; strength: the inverse penalty of the slope.

    A step is one aggregation; only its five sums reach the driver. (0, 0) without rows.
    """
    q = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(p)))
    x = rows.select(F.log(q / (1 - q)).alias("z"), F.col(won).cast("double").alias("y")).where("z is not null and y is not null").persist()
    a = b = 0.0
    try:
        for _ in range(steps):
            chance = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
            z, off, bend = F.col("z"), chance - F.col("y"), chance * (1 - chance)
            ga, gb, haa, hab, hbb = (v or 0.0 for v in x.agg(F.sum(off), F.sum(off * z), F.sum(bend), F.sum(bend * z), F.sum(bend * z * z)).first())
            gb, hbb = gb + b / strength, hbb + 1 / strength
            size = haa * hbb - hab * hab
            if size <= 0:
                break
            step = (hbb * ga - hab * gb) / size, (haa * gb - hab * ga) / size
            a, b = a - step[0], b - step[1]
            if max(map(abs, step)) < 1e-12:
                break
    finally:
        x.unpersist()
    return a, b


def winner_classifier(train: DataFrame, features: list[str], won: str, trees: int = 140):
    """A function from rows to rows with "p", a runner's share of its race's boosted chances; rows need the column race."""
    from .windows import share

    learner = GBTClassifier(featuresCol="__raw", labelCol="__y", maxIter=trees, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=LEAF, seed=42)
    model = Pipeline(stages=[*prepared(features, False), learner]).fit(train.withColumn("__y", F.col(won).cast("double")))
    from pyspark.ml.functions import vector_to_array

    def predict(rows: DataFrame) -> DataFrame:
        chance = vector_to_array("probability")[1]
        return model.transform(rows).withColumn("p", share(chance, ["race"])).select(*rows.columns, "p")

    return predict
