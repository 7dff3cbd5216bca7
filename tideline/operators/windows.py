"""Windows over earlier rows, and within groups.

What a row may see of its own key ends the day before it: prior() adds rows up by key and day first,
so every row of a day sees the same past and a window sees one row a day. Running totals over all
rows (no key) run over days too, never over the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior(rows: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """keys, day and the sums over all strictly earlier days; 0 without any."""
    by_day = rows.groupBy(*keys, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return by_day.select(*keys, day, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def smoothed(hits: Column, n: Column, share: float, weight: float) -> Column:
    """A rate drawn towards a share by so many imagined rows."""
    return (hits + share * weight) / (n + weight)


def recent(keys: list[str], order: list[Column | str], k: int, current: bool = False) -> Window:
    """The last k rows of a key, before the current one or with it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0) if current else Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, -1)


def decayed_mean(rows: Column, now: Column, half_life: float, centre: float, weight: float) -> Column:
    """The mean of an array of (day, value) decayed by age, drawn towards a centre."""
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))

    def add(s: Column, x: Column) -> Column:
        w = F.pow(F.lit(0.5), (now - x["day"]) / half_life)
        return F.struct((s["v"] + w * x["value"]).alias("v"), (s["w"] + w).alias("w"))

    return F.aggregate(rows, zero, add, lambda s: (s["v"] + centre * weight) / (s["w"] + weight))


def share(p: Column, group: list[str]) -> Column:
    """p over its group's sum; equal shares if that is 0."""
    w = Window.partitionBy(*group)
    total = F.sum(p).over(w)
    return F.when(total > 0, p / total).otherwise(1 / F.count(F.lit(1)).over(w))


def softmax(u: Column, group: list[str], widest: float = 60.0) -> Column:
    w = Window.partitionBy(*group)
    e = F.exp(F.greatest(F.lit(-widest), u - F.max(u).over(w)))
    return e / F.sum(e).over(w)


def capped(rows: DataFrame, p: str, group: list[str], target: Column, most: float = 0.98, rounds: int = 5) -> DataFrame:
    """rows with p scaled so that its group sums to target, none above `most`: cap, hand the rest on, repeat."""
    w = Window.partitionBy(*group)
    rows = rows.withColumn(p, F.col(p) / F.sum(p).over(w) * target)
    for _ in range(rounds):
        full = F.col(p) >= most
        rows = rows.withColumns({"__free": F.sum(F.when(full, 0.0).otherwise(F.col(p))).over(w), "__held": F.sum(F.when(full, most).otherwise(0.0)).over(w)})
        scaled = F.when(F.col("__free") > 0, F.col(p) * (target - F.col("__held")) / F.col("__free")).otherwise(F.col(p))
        rows = rows.withColumn(p, F.when(full, F.lit(most)).otherwise(scaled))
    return rows.withColumn(p, F.least(F.col(p), F.lit(most))).drop("__free", "__held")


def equity(days: DataFrame, day: str, gain: str, start: float = 100.0) -> DataFrame:
    """day, equity, peak, drawdown of a table of one row a day."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = days.withColumn("equity", start + F.sum(gain).over(w))
    return out.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w))).withColumn("drawdown", F.col("peak") - F.col("equity"))
