"""Candidate models over seasons; Spark's learners have no counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import selection
from ..registry import query, table
from .joins import O, orders


def seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a match with a count that two of its features move, in years that are its seasons."""
    i, k = F.col("id"), F.col("key")
    o = orders(spark, sf).select("id", "day", F.floor(F.col("day") / 365).alias("season"), (i % 13 / 13.0).alias("a"), (k % 7 / 7.0).alias("b"), F.when(i % 11 > 0, i % 5 / 5.0).alias("c"))
    return o.withColumns({"baseline": F.lit(9.0), "total": F.floor(6 + 4 * F.col("a") + 3 * F.col("b") + i % 3)})


@query()
def q_candidates(spark: SparkSession, sf: str) -> DataFrame:
    names = ("dynamic", "poisson_all", "poisson_recent", "residual_recent")
    rows = seasons(spark, sf)
    last = rows.select("season").distinct().count() - 1  # one fold: the newest season after all others
    got = C.walk_forward(rows, ["a", "b", "c"], "total", "baseline", "season", "day", names, first=last, trees=3)
    return C.scores(got, "total", names).withColumn("mae", F.round("mae", 4))


@query(f"""
WITH RECURSIVE {O}, r AS (SELECT id, ln(p / (1 - p)) AS z, won FROM (SELECT id, (1 + id % 97) / 99.0::DOUBLE AS p, (price > 200000)::INT AS won FROM o)), g AS (SELECT z, count(*) AS n, sum(won) AS h FROM r GROUP BY z),
w AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT step, a, b, sum(n * p - h) AS ga, sum((n * p - h) * z) + b / 0.5 AS gb, sum(n * p * (1 - p)) AS haa, sum(n * p * (1 - p) * z) AS hab, sum(n * p * (1 - p) * z * z) + 1 / 0.5 AS hbb
    FROM (SELECT w.*, g.*, 1 / (1 + exp(-(a + b * g.z))) AS p FROM w, g WHERE step < 12) GROUP BY step, a, b))
SELECT id, round(1 / (1 + exp(-(a + b * z))), 6) AS calibrated FROM r, w WHERE step = 12
""")
def q_line_calibration(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf).select("id", ((1 + F.col("id") % 97) / 99.0).alias("p"), (F.col("price") > 200000).cast("int").alias("won"))
    intercept, slope = C.line_calibration(f, "p", "won")
    return f.select("id", F.round(1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.log(F.col("p") / (1 - F.col("p")))))), 6).alias("calibrated"))


def worth(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by day with features of their items: how many items are expected."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("y"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("price"), F.max("l_suppkey").alias("supplier"))
    return items.join(orders(spark, sf).select("id", "day"), "id")


@query()
def q_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """What dropping each feature costs out of sample."""
    a = selection.ablation(worth(spark, sf), ["quantity", "discount", "tax", "price", "supplier"], "y", "day", line=4.5)
    return spark.createDataFrame(a.round(9), "feature string, mae_delta double, brier_delta double, folds int")


@query()
def q_selected_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features that are kept: one row."""
    s = selection.selected(worth(spark, sf), ["quantity", "discount", "tax", "price", "supplier"], "y", "day", most=3, line=4.5)
    return spark.createDataFrame([tuple(s.values())], "features array<string>, adopted boolean, base_mae double, kept_mae double, folds int, note string")
