"""Bootstraps as one aggregation.

Blocks (days, or days and sports) are added up first. A draw weighs each block by how often it is taken, a
Poisson count of mean 1 that a hash of block and draw decides: every block can weigh itself, draws need no
order and no generator, and a rerun draws the same. All draws are summed in one aggregation, combined
before anything is shuffled; what is shuffled is a row a draw, not a row a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

#: The chance that a Poisson count of mean 1 is at most 0, 1, 2, ...
UP_TO = [math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def weight(block: Column, draw: Column, seed: int) -> Column:
    """How often a draw takes a block: 0, 1, 2, ... with mean 1. block: text."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(seed), block, draw)), 1, 8)
    share = F.conv(word, 16, 10).cast("double") / 2.0**32
    return let(share, lambda u: sum((F.when(u >= c, 1.0).otherwise(0.0) for c in UP_TO), F.lit(0.0)))


def uniform_sql(block: str, draw: str, seed: int) -> str:
    """The hash of a block and a draw as a share of its range, for DuckDB."""
    return f"(('0x' || substr(md5('{seed}:' || {block} || ':' || {draw}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def weight_sql(u: str) -> str:
    """weight() of such a share."""
    return "(" + " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in UP_TO) + ")"


def draws(blocks: DataFrame, block: Column, sums: dict[str, Column], n: int, seed: int) -> DataFrame:
    """draw, and the sums over all blocks of each draw. blocks: a row a block, already added up."""
    spread = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism)  # few small rows become many
    drawn = spread.select(block.cast("string").alias("__b"), *[c.cast("double").alias(k) for k, c in sums.items()], F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    weighed = drawn.withColumn("__w", weight(F.col("__b"), F.col("draw"), seed)).where("__w > 0")
    found = weighed.groupBy("draw").agg(*[F.sum(F.col("__w") * F.col(k)).alias(k) for k in sums])
    every = blocks.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("draw"))
    return every.join(found, "draw", "left").fillna(0.0)


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the rank nearest to a share of a sorted array; halves go up."""
    return F.element_at(values, F.floor((F.size(values) - 1) * q + 0.5).cast("int") + 1)


def interpolated(values: Column, q: float) -> Column:
    """A quantile of a sorted array, between its two nearest values."""
    at = (F.size(values) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.size(values)))
    return a + (b - a) * (at - low)


def intervals(rows: DataFrame, block: list[str], gain: Column, stake: Column, n: int = 2000, seed: int = 20260713, shares: tuple[float, ...] = (0.05, 0.95, 0.025, 0.975)) -> DataFrame:
    """One row: blocks, roi, and the nearest-rank percentiles of the return over bootstrapped blocks; zeros without rows. A draw without stakes returns 0."""
    daily = rows.groupBy(*block).agg(F.sum(gain).alias("__gain"), F.sum(stake).alias("__stake"))
    named = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in block])
    drawn = draws(daily, named, {"gain": F.col("__gain"), "stake": F.col("__stake")}, n, seed)
    ratio = F.when(F.col("stake") != 0, F.col("gain") / F.col("stake")).otherwise(0.0)
    sorted_ = drawn.agg(F.sort_array(F.collect_list(ratio)).alias("v"))  # n values
    whole = daily.agg(F.count("*").alias("blocks"), F.coalesce(F.try_divide(F.sum("__gain"), F.sum("__stake")), F.lit(0.0)).alias("roi"))
    return whole.crossJoin(F.broadcast(sorted_)).select("blocks", "roi", *[nearest_rank(F.col("v"), q).alias(f"p{round(q * 1000)}") for q in shares])
