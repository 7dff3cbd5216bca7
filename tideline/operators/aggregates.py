"""Scores of forecasts, reliability, returns, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reliability(rows: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """bin, n, predicted, observed; the last bin is closed."""
    bin_ = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def calibration_error(table: DataFrame) -> DataFrame:
    """expected, maximum: the gaps of a reliability table."""
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return table.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("expected"), F.max(gap).alias("maximum"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column, eps: float = 1e-8) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def entropy(rows: DataFrame, key: str) -> DataFrame:
    """entropy (a share of the largest), kinds, corrected bits of a column's values."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    p = F.col("n") / F.col("total")
    s = n.join(F.broadcast(total)).agg(F.sum(-p * F.log(p)).alias("h"), F.count("*").alias("k"), F.max("total").alias("total"))
    return s.select(F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k"))).otherwise(0.0).alias("entropy"), F.col("k").alias("kinds"), (F.col("h") / F.log(F.lit(2.0)) + (F.col("k") - 1) / (2 * F.col("total") * F.log(F.lit(2.0)))).alias("bits"))
