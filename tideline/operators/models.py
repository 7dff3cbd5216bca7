"""Small models fitted over all rows: each pass is one aggregation, and only its sums reach the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled(p: np.ndarray, n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of hits over groups in order of p, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for count, hit in zip(n, hits, strict=True):
        blocks.append([count, hit, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c, h, k = blocks.pop()
            blocks[-1][0] += c
            blocks[-1][1] += h
            blocks[-1][2] += k
    return np.concatenate([np.full(int(k), h / c) for c, h, k in blocks]) if blocks else np.zeros(0)


def isotonic(rows: DataFrame, keys: list[str], p: str, y: str, grid: int = 10_000) -> DataFrame:
    """keys, p, n, fitted: a step function. Rows are pooled on a grid of p first, which bounds a key's group."""
    at = (F.round(F.col(p) * grid) / grid).alias("p")
    cells = rows.groupBy(*keys, at).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("hits"))

    def step(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("p")
        return g.assign(fitted=pooled(g["p"].to_numpy(), g["n"].to_numpy(), g["hits"].to_numpy()))

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", p double, n long, hits double, fitted double"
    return cells.groupBy(*keys).applyInPandas(step, schema).drop("hits")


def temperature(rows: DataFrame, p: str, y: str, steps: int = 60, grid: int = 10_000) -> float:
    """The temperature that minimises log loss, by bisection on its slope over a grid of p."""
    cells = rows.groupBy((F.round(F.col(p) * grid) / grid).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("hits")).toPandas()
    q = np.clip(cells["p"].to_numpy(), 1e-6, 1 - 1e-6)
    z, n, hits = np.log(q / (1 - q)), cells["n"].to_numpy(), cells["hits"].to_numpy()
    low, high = 1 / 6, 4.0  # of the inverse temperature, in which log loss is convex
    for _ in range(steps):
        b = (low + high) / 2
        slope = (z * (n / (1 + np.exp(-b * z)) - hits)).sum()
        low, high = (low, b) if slope > 0 else (b, high)
    return 2 / (low + high)


def gradient_step(rows: DataFrame, x: list[str], y: str, w: list[float], rate: float, l2: float) -> list[float]:
    """One step of count_regression(): an aggregation over the rows."""
    mean = F.exp(w[0] + sum((F.col(c) * v for c, v in zip(x, w[1:], strict=True)), F.lit(0.0)))
    error = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col(y) - mean))
    grads = rows.agg(F.avg(error), *[F.avg(error * F.col(c)) for c in x]).first()
    return [v + rate * (g - l2 * v * (i > 0)) for i, (v, g) in enumerate(zip(w, grads, strict=True))]


def count_regression(rows: DataFrame, x: list[str], y: str, epochs: int = 30, rate: float = 0.025, l2: float = 0.003) -> list[float]:
    """Intercept and weights of log E[y] by gradient steps; errors clipped to +-4. One aggregation an epoch over rows that are kept, not made again."""
    rows = rows.select(*x, y).persist()
    try:
        w = [float(np.log(max(rows.agg(F.avg(y)).first()[0] or 0.0, 1e-6)))] + [0.0] * len(x)
        for _ in range(epochs):
            w = gradient_step(rows, x, y, w, rate, l2)
        return w
    finally:
        rows.unpersist()


def together(rows: DataFrame, group: str) -> DataFrame:
    """rows, kept by group and in its order: windows over a group, however often, neither move nor sort them again."""
    return rows.repartition(group).sortWithinPartitions(group).persist()


def conditional_logit(rows: DataFrame, group: str, x: list[str], won: str, epochs: int = 60, rate: float = 0.045, l2: float = 0.004) -> list[float]:
    """Weights of the softmax within groups; one window and one aggregation an epoch, over rows that lie together by group."""
    w, g = [0.0] * len(x), Window.partitionBy(group)
    rows = together(rows.select(group, *x, won), group)
    try:
        groups = max(rows.select(group).distinct().count(), 1)
        for _ in range(epochs):
            u = sum((F.col(c) * v for c, v in zip(x, w, strict=True)), F.lit(0.0))
            e = rows.withColumn("__u", u).withColumn("__e", F.exp(F.col("__u") - F.max("__u").over(g)))
            e = e.withColumn("__d", F.col(won) - F.col("__e") / F.sum("__e").over(g))
            grads = e.agg(*[F.sum(F.col("__d") * F.col(c)) for c in x]).first()
            w = [v + rate * ((d or 0.0) / groups - l2 * v) for v, d in zip(w, grads, strict=True)]
        return w
    finally:
        rows.unpersist()


def logistic(rows: DataFrame, x: list[str], y: str, epochs: int = 60, rate: float = 0.045, l2: float = 0.004) -> list[float]:
    """Intercept and weights of the log odds by gradient steps from 0; the intercept is not drawn back. One aggregation an epoch."""
    rows = rows.select(*x, F.col(y).cast("double").alias(y)).persist()
    try:
        w = [0.0] * (1 + len(x))
        for _ in range(epochs):
            u = sum((F.col(c) * v for c, v in zip(x, w[1:], strict=True)), F.lit(w[0]))
            error = 1 / (1 + F.exp(-u)) - F.col(y)
            grads = rows.agg(F.avg(error), *[F.avg(error * F.col(c)) for c in x]).first()
            w = [v - rate * ((g or 0.0) + l2 * v * (i > 0)) for i, (v, g) in enumerate(zip(w, grads, strict=True))]
        return w
    finally:
        rows.unpersist()


def folds(rows: DataFrame, day: str, n: int = 4, purge: int = 10, embargo: int = 3, first: float = 0.5) -> DataFrame:
    """fold, day, part (train, test) of expanding folds: tests follow one another after the first part of
    the days; training ends `purge` days before its test, and each test but the first begins `embargo` days later."""
    days = rows.groupBy(day).agg(F.count("*").alias("rows"))  # one row a day
    at = days.select(day, "rows", F.row_number().over(Window.orderBy(day)).alias("i"), F.count("*").over(Window.partitionBy()).alias("days"))
    start = F.floor(F.col("days") * first)
    width = (F.col("days") - start) / n
    each = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    begins, ends = start + F.floor(width * F.col("fold")), start + F.floor(width * (F.col("fold") + 1))
    edges = each.groupBy("fold").agg(F.min(F.when(F.col("i") > begins, F.col(day))).alias("b"), F.max(F.when(F.col("i") <= ends, F.col(day))).alias("e"))
    each = each.join(F.broadcast(edges), "fold")  # n rows
    begin = F.col("b") + F.when(F.col("fold") > 0, embargo).otherwise(0)
    part = F.when(F.col(day) < F.col("b") - purge, "train").when((F.col(day) >= begin) & (F.col(day) <= F.col("e")), "test")
    return each.select("fold", day, "rows", part.alias("part")).where("part is not null")


def second_place(p: Column, group: list[str]) -> Column:
    """The probability of finishing first or second, by removing the winner and renormalising."""
    odds = p / (1 - p)
    return p + p * (F.sum(odds).over(Window.partitionBy(*group)) - odds)
