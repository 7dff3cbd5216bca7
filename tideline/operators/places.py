"""Chances of finishing among the first few, from chances of winning.

Who finishes first is drawn by the chances of winning, who comes next by those of the runners left, raised
to a power (1: the plain model; below it, a favourite that does not win is less certain of a place). Summed
over everybody who may finish before, as array expressions over a race's runners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

#: Chances below this count as this.
LEAST = 1e-9


def paid(field: Column) -> Column:
    """How many places a field of so many runners is paid for."""
    return F.when(field >= 7, 3).when(field >= 4, 2).otherwise(0)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def placed(win: Column, slots: Column, power: float = 1.0) -> Column:
    """For each of an array of chances of winning the chance to be among the first `slots` (0 to 3, or the whole field).

    Runners are at most a few dozen; the work grows with the square of their number.
    """
    first = F.transform(win, lambda p: F.greatest(F.coalesce(p.cast("double"), F.lit(0.0)), F.lit(LEAST)))

    def weighed(first: Column, total: Column) -> Column:
        # a, v: the weight for the first and for later places; w: what is left for the others once this one has finished
        v = F.transform(first, lambda p: F.pow(p, F.lit(power)))
        rest = lambda v: F.transform(v, lambda x, i: F.struct((F.get(first, i) / total).alias("a"), x.alias("v"), _total(F.transform(v, lambda y, j: F.when(i == j, 0.0).otherwise(y))).alias("w")))
        return let(v, rest)

    # of every pair (i before j): the chance of that beginning, over what the two leave
    pair = lambda i, j: i["a"] * j["v"] / i["w"] / F.greatest(i["w"] - j["v"], F.lit(LEAST**2))

    def by_two(each: Column) -> Column:
        return let(_total(F.transform(each, lambda r: r["a"] / r["w"])), lambda second: F.transform(each, lambda r: r["a"] + r["v"] * (second - r["a"] / r["w"])))

    def by_three(each: Column) -> Column:
        begins = F.transform(each, lambda r, i: _total(F.transform(each, lambda s, j: F.when(i == j, 0.0).otherwise(pair(r, s) + pair(s, r)))))
        third = lambda begins, whole, two: F.transform(each, lambda r, i: F.get(two, i) + r["v"] * (whole - F.get(begins, i)))
        return let(begins, lambda b: let(_total(b) / 2, lambda whole: let(by_two(each), lambda two: third(b, whole, two))))

    def chances(each: Column) -> Column:
        return F.when(slots == 1, F.transform(each, lambda r: r["a"])).when(slots == 2, by_two(each)).when(slots == 3, by_three(each))

    found = let(first, lambda f: let(_total(f), lambda total: let(weighed(f, total), chances)))
    n = F.size(win)
    bounded = F.transform(found, lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return F.when(slots <= 0, F.transform(win, lambda _: F.lit(0.0))).when(slots >= n, F.transform(win, lambda _: F.lit(1.0))).otherwise(bounded)


def place_probabilities(runners: DataFrame, race: list[str], runner: list[str], win: str, name: str = "place", slots=paid, power: float = 1.0) -> DataFrame:
    """runners with a further column, the chance of a paid place; slots says from the size of the field how many there are.

    A race's runners meet in one row. Runners that are alike in all columns get the same chance.
    """
    one = F.struct(*runner, F.struct(*runners.columns).alias("__row"))
    races = runners.groupBy(*race).agg(F.sort_array(F.collect_list(one)).alias("__r"))  # a race's runners
    chances = placed(F.transform("__r", lambda r: r["__row"][win]), slots(F.size("__r")), power)
    both = races.select(F.explode(F.arrays_zip(F.transform("__r", lambda r: r["__row"]).alias("row"), chances.alias("p"))).alias("z"))
    return both.select("z.row.*", F.col("z.p").alias(name))
