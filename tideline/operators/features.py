"""Features of a row from its keys' earlier days: recency means, meetings, tail means, leagues.

past() gives a row the last k values of its key from strictly earlier days: values are ranked within a
key and day first, so that no day passes on more than k, and a window then looks back over k days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import beside, trailing


def past(rows: DataFrame, keys: list[str], day: str, order: str, value: Column, k: int, weight: Column | None = None) -> DataFrame:
    """keys, day, past: an array of (day, order, value, weight), oldest first, of the last k rows before each day."""
    weight = F.lit(1.0) if weight is None else weight
    last = Window.partitionBy(*keys, day).orderBy(F.col(order).desc())
    few = rows.select(*keys, day, F.struct(F.col(day).alias("day"), F.col(order).alias("order"), value.alias("value"), weight.alias("weight")).alias("__x"), F.row_number().over(last).alias("__n"))
    by_day = few.where(F.col("__n") <= k).groupBy(*keys, day).agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(-k, -1)
    every = F.flatten(F.collect_list("__x").over(before))
    return by_day.select(*keys, day, F.slice(every, F.greatest(F.lit(1), F.size(every) - k + 1), k).alias("past"))


def weighted(items: Column, weight, default: Column | float, drawn: float = 0.0) -> Column:
    """The mean of past's values; weight(item, age in rows, number of items) beside each item's own. drawn: rows of the default."""
    n = F.size(items)
    pairs = F.transform(items, lambda x, i: F.struct(x["value"].alias("v"), (x["weight"] * weight(x, n - 1 - i, n)).alias("w")))
    add = lambda s, p: F.struct((s["v"] + p["v"] * p["w"]).alias("v"), (s["w"] + p["w"]).alias("w"))
    default = F.lit(default) if isinstance(default, float) else default
    start = F.struct((default * drawn).alias("v"), F.lit(float(drawn)).alias("w"))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.aggregate(pairs, start, add, lambda s: s["v"] / s["w"])).otherwise(default)


def recency_mean(items: Column, default: float, oldest: float = 0.45) -> Column:
    """Weights rise geometrically from `oldest` for the oldest to 1 for the newest."""
    return weighted(items, lambda x, age, n: F.when(n > 1, F.pow(F.lit(oldest), age / F.greatest(n - 1, F.lit(1)))).otherwise(oldest), default)


def position_decayed_mean(items: Column, default: float, keep: float = 0.88, drawn: float = 3.0) -> Column:
    """Weights fall by a factor a row; the default counts as so many rows."""
    return weighted(items, lambda x, age, n: F.pow(F.lit(keep), age), default, drawn)


def dated_mean(items: Column, now: Column, default: Column | float, half_life: float) -> Column:
    """Weights halve every so many days."""
    return weighted(items, lambda x, age, n: F.pow(F.lit(0.5), F.greatest(now - x["day"], F.lit(0)) / half_life), default)


def mean(items: Column, default: float) -> Column:
    return weighted(items, lambda x, age, n: F.lit(1.0), default)


def sides(matches: DataFrame) -> DataFrame:
    """id, day, division, team, at_home, scored, conceded: two rows a match of id, day, division, home, away, home_n, away_n."""
    one = lambda team, own, other, at_home: matches.select("id", "day", "division", F.col(team).alias("team"), F.lit(at_home).alias("at_home"), F.col(own).alias("scored"), F.col(other).alias("conceded"))
    return one("home", "home_n", "away_n", True).unionByName(one("away", "away_n", "home_n", False))


def meetings(matches: DataFrame, k: int = 5, half_life: float = 365.0, default: float = 10.3) -> DataFrame:
    """id, met: the mean total of the last k matches of the same two teams, whoever was at home."""
    pair = F.array_sort(F.array("home", "away"))
    rows = matches.select("id", "day", pair[0].alias("a"), pair[1].alias("b"), (F.col("home_n") + F.col("away_n")).alias("total"))
    found = beside(rows, past(rows, ["a", "b"], "day", "id", F.col("total"), k), ["a", "b", "day"])
    return found.select("id", dated_mean(F.col("past"), F.col("day"), default, half_life).alias("met"))


def league_means(matches: DataFrame, k: int = 100, home: float = 5.5, away: float = 4.8) -> DataFrame:
    """division, day, home, away: means over a division's last k matches before each of its days."""
    one = lambda c: past(matches, ["division"], "day", "id", F.col(c), k).select("division", "day", F.col("past").alias(c))
    both = one("home_n").join(one("away_n"), ["division", "day"])
    return both.select("division", "day", mean(F.col("home_n"), home).alias("home"), mean(F.col("away_n"), away).alias("away"))


def division_scale(now: Column, target: Column, low: float = 0.85, high: float = 1.15) -> Column:
    """By how much counts of another division are scaled to those of the target division."""
    return F.greatest(F.lit(low), F.least(F.lit(high), target / now))


def standing(rows: DataFrame, support: str, long: int = 900, short: int = 420, least: int = 8) -> DataFrame:
    """team, day, share, promoted: a team's part of games in the support division, and whether it has just come up from it."""
    of = {"top": (F.col("division") != support).cast("int"), "low": (F.col("division") == support).cast("int")}
    far, near = trailing(rows, ["team"], "day", long, of), trailing(rows, ["team"], "day", short, of).withColumnsRenamed({"top": "top_now", "low": "low_now"})
    n = lambda c: F.coalesce(c, F.lit(0))
    share = F.when(n("top") + n("low") > 0, n("low") / (n("top") + n("low"))).otherwise(0.0)
    both = far.join(near, ["team", "day"])
    return both.select("team", "day", share.alias("share"), ((n("low_now") >= least) & (n("top_now") < least)).cast("int").alias("promoted"))
