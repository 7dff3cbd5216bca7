"""Choosing sides, a grid of betting policies, and day-block bootstraps of their returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import draws, interpolated

#: The grid of policies.
MAXIMUM_ODDS, MINIMUM_VALUE = (3.0, 5.0, 10.0), (0.0, 0.02, 0.05, 0.08, 0.1, 0.15)


def sided(rows: DataFrame) -> DataFrame:
    """rows with direction, value, odds, won of the better side; over if both are as good.

    rows: over_value, under_value (expected values), over_odds, under_odds, over_won.
    """
    over = F.col("over_value") >= F.col("under_value")
    pick = lambda a, b: F.when(over, a).otherwise(b)
    return rows.select(
        "*", pick(F.lit("over"), F.lit("under")).alias("direction"), pick(F.col("over_value"), F.col("under_value")).alias("value"),
        pick(F.col("over_odds"), F.col("under_odds")).alias("odds"), pick(F.col("over_won"), ~F.col("over_won")).alias("won"),
    )


def taken(maximum_odds: float, minimum_value: float) -> Column:
    """Whether a policy takes a sided row."""
    return (F.col("value") >= minimum_value) & (F.col("odds") > 1) & (F.col("odds") <= maximum_odds)


def grid_days(rows: DataFrame, day: str = "day") -> DataFrame:
    """maximum_odds, minimum_value, day, net, bets of sided rows: every policy in one pass, as columns of one aggregation."""
    net = F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0)
    cells = [(m, v) for m in MAXIMUM_ODDS for v in MINIMUM_VALUE]
    sums = [F.struct(F.lit(m).alias("maximum_odds"), F.lit(v).alias("minimum_value"), F.sum(F.when(taken(m, v), net)).alias("net"), F.count(F.when(taken(m, v), 1)).alias("bets")) for m, v in cells]
    by_day = rows.groupBy(day).agg(F.array(*sums).alias("c"))
    return by_day.select(day, F.explode("c").alias("c")).select("c.maximum_odds", "c.minimum_value", day, "c.net", "c.bets").where("bets > 0")


def bootstrapped(days: pd.DataFrame, seed: int, iterations: int = 1000, level: float = 0.1, day: str = "day") -> float:
    """A quantile of the ratio of sums over days drawn with replacement; -1 without any."""
    if not len(days):
        return -1.0
    days = days.sort_values(day)
    net, bets, n = days["net"].to_numpy(dtype=float), days["bets"].to_numpy(dtype=float), len(days)
    rng = np.random.default_rng(seed)
    drawn = (rng.choice(n, size=n, replace=True) for _ in range(iterations))
    return float(np.quantile([net[i].sum() / bets[i].sum() for i in drawn], level))


def lower_returns(days: DataFrame, iterations: int = 1000, day: str = "day") -> DataFrame:
    """maximum_odds, minimum_value, bets, roi, lower of each policy of grid_days(), the days drawn by numpy's generator; a group is a policy's days, never its rows."""

    def step(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lower = bootstrapped(g, int(202607 + key[0] * 100 + key[1] * 1000), iterations, day=day)
        return pd.DataFrame([(*key, int(g["bets"].sum()), float(g["net"].sum() / g["bets"].sum()), lower)], columns=["maximum_odds", "minimum_value", "bets", "roi", "lower"])

    return days.groupBy("maximum_odds", "minimum_value").applyInPandas(step, "maximum_odds double, minimum_value double, bets long, roi double, lower double")


def drawn_returns(rows: DataFrame, iterations: int = 1000, seed: int = 202607, level: float = 0.1, day: str = "day") -> DataFrame:
    """What lower_returns() says, from days that hashes draw: every policy and every draw in one aggregation over the days."""
    net = F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0)
    cells = [(m, v) for m in MAXIMUM_ODDS for v in MINIMUM_VALUE]
    sums = {f"net_{i}": F.sum(F.when(taken(m, v), net).otherwise(0.0)) for i, (m, v) in enumerate(cells)} | {f"bets_{i}": F.count(F.when(taken(m, v), 1)) for i, (m, v) in enumerate(cells)}
    days = rows.groupBy(day).agg(*[c.alias(k) for k, c in sums.items()])
    drawn = draws(days, F.col(day), {k: F.col(k) for k in sums}, iterations, seed)
    ratios = [F.sort_array(F.collect_list(F.when(F.col(f"bets_{i}") > 0, F.col(f"net_{i}") / F.col(f"bets_{i}")))).alias(f"v_{i}") for i in range(len(cells))]  # a value a draw
    lower, whole = drawn.agg(*ratios), days.agg(*[F.sum(k).alias(k) for k in sums])
    one = [F.struct(F.lit(m).alias("maximum_odds"), F.lit(v).alias("minimum_value"), F.col(f"bets_{i}").alias("bets"), (F.col(f"net_{i}") / F.col(f"bets_{i}")).alias("roi"), interpolated(F.col(f"v_{i}"), level).alias("lower")) for i, (m, v) in enumerate(cells)]
    both = whole.crossJoin(F.broadcast(lower))  # a row each
    return both.select(F.explode(F.filter(F.array(*[F.when(F.col(f"bets_{i}") > 0, c) for i, c in enumerate(one)]), lambda c: c.isNotNull())).alias("c")).select("c.*")


def chosen(returns: DataFrame, least: int = 100) -> DataFrame:
    """The policy of the highest lower return among those of enough bets (of equals the first of the grid), whether it may trade, and why."""
    best = F.max_by(F.struct("maximum_odds", "minimum_value", "bets", "roi", "lower"), F.struct("lower", -F.col("maximum_odds"), -F.col("minimum_value")))
    one = returns.where(F.col("bets") >= least).agg(best.alias("b"))
    reason = F.when(F.col("b").isNull(), "too few bets").when(F.col("b.lower") > 0, "passed").otherwise("lower return not positive")
    zero, field = F.lit(0.0), lambda c, other: F.coalesce(F.col(f"b.{c}"), other)
    return one.select(
        field("maximum_odds", zero).alias("maximum_odds"), field("minimum_value", zero).alias("minimum_value"), field("bets", F.lit(0)).alias("bets"),
        field("roi", zero).alias("roi"), field("lower", F.lit(-1.0)).alias("lower"), (field("lower", F.lit(-1.0)) > 0).alias("enabled"), reason.alias("reason"),
    )


def parted(rows: DataFrame, day: str, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """rows with part (development, validation, locked) by days in order, and days, how many there are."""
    days = rows.select(day).distinct()  # one row a day from here on
    ranked = days.select(day, F.row_number().over(Window.orderBy(day)).alias("__n"), F.count("*").over(Window.partitionBy()).alias("days"))
    first = F.greatest(F.lit(1), F.floor(F.col("days") * cuts[0] + 1e-9))
    second = F.greatest(first + 1, F.floor(F.col("days") * cuts[1] + 1e-9))
    part = F.when(F.col("__n") <= first, "development").when(F.col("__n") <= second, "validation").otherwise("locked")
    return rows.join(ranked.select(day, "days", part.alias("part")), day)


def gate(rows: DataFrame, day: str = "day", least: int = 30, least_days: int = 20, iterations: int = 1000, seeds: tuple[int, int] = (202607, 202608)) -> DataFrame:
    """One row: enabled, reason, the policy, and its bets, return and lower return on the validation days and on the locked ones.

    The policy is chosen on the validation days. The locked days, the latest, are read for that one policy alone: it may trade only
    if it finds enough bets there, too, and its lower return stays positive. rows: sided().
    """
    held = parted(rows, day)
    policy = chosen(drawn_returns(held.where("part = 'validation'"), iterations, seeds[0], day=day), least)
    names = {"enabled": "__passed", "reason": "__why", "bets": "validation_bets", "roi": "validation_roi", "lower": "validation_lower"}
    one = F.broadcast(policy.withColumnsRenamed(names))  # one row
    takes = (F.col("value") >= F.col("minimum_value")) & (F.col("odds") > 1) & (F.col("odds") <= F.col("maximum_odds")) & (F.col("validation_bets") > 0)
    locked = held.where("part = 'locked'").join(one, takes)
    net = F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0)
    days = locked.groupBy(day).agg(F.sum(net).alias("net"), F.count("*").cast("double").alias("bets"))
    ratio = F.when(F.col("bets") > 0, F.col("net") / F.col("bets"))
    lower = draws(days, F.col(day), {"net": F.col("net"), "bets": F.col("bets")}, iterations, seeds[1]).agg(F.sort_array(F.collect_list(ratio)).alias("v"))  # a value a draw
    sums = days.agg(F.coalesce(F.sum("bets"), F.lit(0.0)).cast("long").alias("locked_bets"), F.coalesce(F.try_divide(F.sum("net"), F.sum("bets")), F.lit(0.0)).alias("locked_roi"))
    all_ = held.agg(F.coalesce(F.max("days"), F.lit(0)).alias("days"))
    out = policy.withColumnsRenamed(names).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(lower)).crossJoin(F.broadcast(all_))  # a row each
    out = out.withColumn("locked_lower", F.when(F.size("v") > 0, interpolated(F.col("v"), 0.1)).otherwise(-1.0))
    reason = F.when(F.col("days") < least_days, "too few days").when(~F.col("__passed"), F.col("__why")).when(F.col("locked_bets") < least, "too few locked bets").when(F.col("locked_lower") <= 0, "locked lower return not positive").otherwise("passed")
    return out.select((reason == "passed").alias("enabled"), reason.alias("reason"), "maximum_odds", "minimum_value", "validation_bets", "validation_roi", "validation_lower", "locked_bets", "locked_roi", "locked_lower")


def implied_means(rows: DataFrame, id_: str, lines: str = "lines", shares: str = "shares", weights: str = "weights", low: float = 0.5, high: float = 30.0, steps: int = 60) -> DataFrame:
    """id_, mean: the Poisson mean whose chances above a row's half lines fit their market shares best on the whole, by bisection.

    lines, shares, weights: arrays of a row. Null where a row has no line.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.array([0 if x is None else len(x) for x in batch[lines]], dtype=int)
            line, share, weight = (np.zeros((len(batch), max(1, size.max(initial=0)))) for _ in range(3))
            for i, n in enumerate(size):
                if n:
                    line[i, :n], share[i, :n], weight[i, :n] = batch[lines].iloc[i], batch[shares].iloc[i], batch[weights].iloc[i]
            at = np.floor(line).astype(int)
            k = np.arange(at.max(initial=0) + 1)
            log_k = np.cumsum(np.log(np.maximum(k, 1)))

            def residual(mean: np.ndarray) -> np.ndarray:
                below = np.cumsum(np.exp(k * np.log(mean)[:, None] - mean[:, None] - log_k), axis=1)
                return (weight * (1 - np.take_along_axis(below, at, axis=1) - share)).sum(axis=1)

            a, b = np.full(len(batch), low), np.full(len(batch), high)
            b = np.where(residual(a) > 0, low, b)
            a = np.where(residual(np.full(len(batch), high)) < 0, high, a)
            for _ in range(steps):
                mid = (a + b) / 2
                under = residual(mid) < 0
                a, b = np.where(under, mid, a), np.where(under, b, mid)
            yield pd.DataFrame({id_: batch[id_], "mean": np.where(size > 0, (a + b) / 2, np.nan)})

    return rows.select(id_, lines, shares, weights).mapInPandas(solve, f"{id_} {rows.schema[id_].dataType.simpleString()}, mean double")
