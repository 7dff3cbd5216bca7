"""Joins by time, distance and priority, as equi-joins and windows whose partitions stay small.

An as-of join cuts every key's history into buckets of time (a day): a window looks back inside the
bucket, and one row a key and bucket carries the last value over from earlier ones. A key that holds
a large share of all rows is thus spread over its days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, take: dict[str, Column],
    strict: bool = False, tie: Column | None = None, bucket: int = DAY,
) -> DataFrame:
    """left with the columns `take` of the last row of right at or before (strict: before) its time; null if none.

    Times are longs. Of rows at the same time the one with the largest `tie` counts.
    """
    columns = left.columns
    value = F.struct(*[c.alias(n) for n, c in take.items()])
    tie = F.lit(0).cast("long") if tie is None else tie.cast("long")
    l = left.select(*keys, left_time.cast("long").alias("__t"), F.lit(0 if strict else 2).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*columns).alias("__l"))
    r = right.select(*keys, right_time.cast("long").alias("__t"), F.lit(1).alias("__side"), tie.alias("__tie"), value.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / bucket).cast("long"))
    order = [F.col("__t"), F.col("__side"), F.col("__tie")]
    here = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__here", F.last("__r", ignorenulls=True).over(here)).where("__l is not null")
    ends = both.groupBy(*keys, "__b").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    # a row whose key or time is null matches nothing and stays: what stood beside it in its window does not count
    whole = F.lit(True)
    for c in (*keys, "__t"):
        whole = whole & F.col(c).isNotNull()
    out = seen.join(carry, [*keys, "__b"], "left").withColumn("__v", F.when(whole, F.coalesce("__here", "__carry")))
    return out.select("__l.*", *[F.col(f"__v.{n}").alias(n) for n in take])


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns of the row that has the same keys; a null key equals a null key. right has each key once.

    Rows whose keys are all known meet by plain equality; only the others pay for comparing nulls.
    """
    others = [c for c in right.columns if c not in keys]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    plain = left.where(whole).join(right, keys, "left").select(*left.columns, *others)
    odd = right.where(~whole).select(*[F.col(k).alias(f"__{k}") for k in keys], *others)
    rest = left.where(~whole).join(odd, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return plain.unionAll(rest.select(*left.columns, *others))


def carried(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with further columns: the last known (not null) value of each of `values` in a key's rows up to this one, in order.

    bucket: a column that rises with the order, such as the day: a window looks back inside a bucket, and one row a key and
    bucket brings what was known before it. So a large key is spread over its buckets. Rows whose bucket is null see each other alone.
    """
    rows = rows.withColumn("__b", bucket)
    here = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "__b").agg(*[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"__{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "__b", *[F.when(F.col("__b").isNotNull(), F.last(f"__{n}", ignorenulls=True).over(earlier)).alias(f"__before_{n}") for n in values])
    seen = rows.withColumns({f"__here_{n}": F.last(v, ignorenulls=True).over(here) for n, v in values.items()})
    both = beside(seen, before, [*keys, "__b"])
    return both.withColumns({n: F.coalesce(f"__here_{n}", f"__before_{n}") for n in values}).drop("__b", *[f"__{w}_{n}" for n in values for w in ("here", "before")])


def first_key(left: DataFrame, right: DataFrame, id_: str, tries: list[Column], key: str, value: str) -> DataFrame:
    """id_ and the value of the first of several spellings of a key that right knows; null if it knows none."""
    spelled = F.array(*[F.struct(F.lit(i).alias("rank"), k.alias(key)) for i, k in enumerate(tries)])
    asked = left.select(id_, F.explode(spelled).alias("t")).select(id_, "t.*")
    found = asked.join(right.select(key, value), key).groupBy(id_).agg(F.min_by(value, "rank").alias(value))
    return left.select(id_).join(found, id_, "left")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, take: dict[str, Column], bucket: int = DAY) -> DataFrame:
    """left with the columns of the row of right that is nearest in time; of two, the earlier; of one time, the largest values.

    One pass over both: a window looks back and ahead inside a bucket, and one row a key and bucket
    brings the nearest values of the buckets around it. Rows without key or time match nothing and stay.
    """
    value = F.struct(right_time.cast("long").alias("__at"), *[c.alias(n) for n, c in take.items()])
    l = left.select(*keys, left_time.cast("long").alias("__t"), F.struct(*left.columns).alias("__l"))
    r = right.select(*keys, right_time.cast("long").alias("__t"), value.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / bucket).cast("long"))
    here = Window.partitionBy(*keys, "__b").orderBy("__t")
    seen = both.withColumns({
        "__back": F.max("__r").over(here.rangeBetween(Window.unboundedPreceding, 0)), "__ahead": F.min("__r").over(here.rangeBetween(1, Window.unboundedFollowing)),
    }).where("__l is not null")
    ends = both.groupBy(*keys, "__b").agg(F.max("__r").alias("__high"), F.min("__r").alias("__low"))
    around = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.last("__high", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("__far_back"), F.first("__low", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing)).alias("__far_ahead"))
    whole = F.lit(True)
    for c in (*keys, "__t"):
        whole = whole & F.col(c).isNotNull()
    out = seen.join(ends, [*keys, "__b"], "left")
    back, ahead = F.when(whole, F.coalesce("__back", "__far_back")), F.when(whole, F.coalesce("__ahead", "__far_ahead"))
    out = out.withColumns({"__p": back, "__n": ahead})
    early = F.col("__n").isNull() | (F.col("__t") - F.col("__p.__at") <= F.col("__n.__at") - F.col("__t"))
    return out.withColumn("__v", F.when(F.col("__p").isNotNull() & early, F.col("__p")).otherwise(F.col("__n"))).select("__l.*", *[F.col(f"__v.{n}").alias(n) for n in take])


def trailing(rows: DataFrame, keys: list[str], day: str, days: int, sums: dict[str, Column], least: Column | None = None, same_day: bool = False) -> DataFrame:
    """keys, day and, over the days before it (same_day: up to it), the sums and the least of a value; null if none.

    Rows are added up by key and day first, so a window sees a row a day at most.
    """
    daily = [F.sum(c).alias(n) for n, c in sums.items()] + ([F.min(least).alias("least")] if least is not None else [])
    by_day = rows.groupBy(*keys, day).agg(*daily)
    frame = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, 0 if same_day else -1)
    out = [F.sum(n).over(frame).alias(n) for n in sums] + ([F.min("least").over(frame).alias("least")] if least is not None else [])
    return by_day.select(*keys, day, *out)


def only_candidate(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_day: Column, right_day: Column, days: int = 1) -> DataFrame:
    """left_id and the id of the one row of right within so many days; null if there is none or several.

    Rows meet by blocks of so many days: a row of left asks its own block and the two beside it.
    """
    block = lambda d: F.floor(d / max(days, 1)).cast("long")
    asked = left.select(*keys, left_id, left_day.alias("__at"), F.explode(F.array(*[block(left_day) + i for i in (-1, 0, 1)])).alias("__b"))
    held = right.select(*keys, F.col(right_id), right_day.alias("__on"), block(right_day).alias("__b"))
    found = asked.join(held, [*keys, "__b"]).where(F.abs(F.col("__at") - F.col("__on")) <= days)
    one = found.groupBy(left_id).agg(F.count("*").alias("__n"), F.min(right_id).alias("match")).where("__n = 1").select(left_id, "match")
    return left.select(left_id).join(one, left_id, "left")


def by_shift(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_day: Column, right_day: Column, value: Column, shifts: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """left_id and right's value at the first shift in days that has one; of several the smallest.

    Rows of a key and day ask and answer as one, so that many rows a day make no pairs.
    """
    right = right.select(*keys, right_day.alias("__d"), value.alias("__v")).groupBy(*keys, "__d").agg(F.min("__v").alias("__v"))
    left = left.select(*keys, left_id, left_day.alias("__at"))
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), (F.col("__at") + s).alias("day")) for i, s in enumerate(shifts)])
    asked = left.select(*keys, "__at").distinct().select(*keys, "__at", F.explode(tries).alias("__s")).select(*keys, "__at", "__s.rank", F.col("__s.day").alias("__d"))
    found = asked.join(right, [*keys, "__d"]).groupBy(*keys, "__at").agg(F.min(F.struct("rank", "__v")).alias("b")).select(*keys, "__at", F.col("b.__v").alias("value"))
    return left.join(found, [*keys, "__at"], "left").select(left_id, "value")


def lag_correlations(rows: DataFrame, at: str, value: str, lags: range, block: int = 4096) -> DataFrame:
    """lag, r, n: the correlation of a whole-numbered value with the one so many steps of `at` later, over the n pairs there are.

    Rows of equal `at` are added up first; a block of steps comes with the first steps of the next, and works out the sums of
    all lags, which are whole numbers and exact. Lags reach no further than a block.
    """
    if max(lags) > block:
        raise ValueError("a lag reaches no further than a block")
    x, own = F.col(value).cast("long"), F.floor(F.col(at) / block).cast("long")
    steps = rows.where(F.col(at).isNotNull()).groupBy(at).agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0)).alias("x"), F.coalesce(F.sum(x * x), F.lit(0)).alias("xx"), F.count("*").alias("all"))
    near = F.when(F.pmod(F.col(at), F.lit(block)) < max(lags), F.array(own, own - 1)).otherwise(F.array(own))
    placed = steps.select(F.explode(near).alias("block"), F.col(at).alias("at"), "n", "x", "xx", "all")
    names = ["lag", "all", "n", "a", "b", "aa", "bb", "ab"]

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((4, block + max(lags)), dtype=np.int64)
        held[:, g["at"].to_numpy() - key[0] * block] = g[["n", "x", "xx", "all"]].to_numpy().T
        (n, x, xx, every), out = held[:, :block], []
        for lag in lags:
            m, y, yy, others = held[:, lag : lag + block]
            out.append((lag, int(every @ others), int(n @ m), int(x @ m), int(n @ y), int(xx @ m), int(n @ yy), int(x @ y)))
        return pd.DataFrame(out, columns=names)

    sums = placed.groupBy("block").applyInPandas(add, ", ".join(f"{c} long" for c in names)).groupBy("lag").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[1:]])
    total = {c: F.col(c).cast("double") for c in names[1:]}
    n = total["n"]
    spread = lambda p, q, pq: total[pq] / n - total[p] / n * (total[q] / n)
    wide = F.sqrt(spread("a", "a", "aa") * spread("b", "b", "bb"))
    r = F.when((F.col("n") > 1) & (wide > 0), spread("a", "b", "ab") / wide)
    return sums.where(F.col("all") > 0).select(F.col("lag").cast("int").alias("lag"), r.alias("r"), F.col("all").cast("long").alias("n"))


def resolved(names: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """name, match: the known name that shares most words, as a share of the longer; the smaller of equals.

    Two names that share enough have one of their rarest words in common: of n words the rarest
    n - ceil(least * n) + 1 of each decide which meet, so that a common word does not make all pairs.
    """
    words = lambda df, c: df.select(c, F.array_distinct(F.split(c, " ")).alias("w"))
    a, b = words(names, "name"), words(known, "known")
    each = a.select(F.explode("w").alias("word")).unionByName(b.select(F.explode("w").alias("word")))
    times = each.groupBy("word").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        found = df.select(c, F.size("w").alias("size"), F.explode("w").alias("word")).join(times, "word")
        ranked = found.groupBy(c, "size").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("r"))  # a name's words
        few = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
        return ranked.select(c, F.explode(F.slice("r", F.lit(1), few.cast("int"))).alias("r")).select(c, F.col("r.word").alias("word"))

    met = rarest(a, "name").join(rarest(b, "known"), "word").select("name", "known").distinct()
    pairs = met.join(a.withColumnRenamed("w", "x"), "name").join(b.withColumnRenamed("w", "y"), "known")
    scored = pairs.withColumn("score", F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))).where(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "known")).alias("b"))
    return names.join(best.select("name", F.col("b.known").alias("match"), (-F.col("b.s")).alias("score")), "name", "left")


def actions(old: DataFrame, new: DataFrame, key: str, print_: str) -> DataFrame:
    """key, action: insert, correct, keep or absent, by the fingerprints of old and new rows."""
    both = old.select(key, F.col(print_).alias("__o"), F.lit(True).alias("__in_old")).join(new.select(key, F.col(print_).alias("__n"), F.lit(True).alias("__in_new")), key, "full")
    action = F.when(F.col("__in_old").isNull(), "insert").when(F.col("__in_new").isNull(), "absent").when(F.col("__o").eqNullSafe(F.col("__n")), "keep").otherwise("correct")
    return both.select(key, action.alias("action"))


def quantile(rows: DataFrame, column: str, q: float, held: int = 1000, bins: int = 1000) -> float | None:
    """An exact, interpolated quantile: counts over ranges of values close in on each of its two ranks.

    A range splits into bins, of which the one that holds a rank is next, from its least to its greatest value, until
    it holds `held` rows or one value. No task or driver sees more than `held` values, or the counts of 2 * bins bins.
    Nulls and NaN are left out, infinite values count as 1e308.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    x = x.select(F.least(F.greatest("x", F.lit(-1e308)), F.lit(1e308)).alias("x"))
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = q * (n - 1)
    ranks = sorted({int(at), min(int(at) + 1, n - 1)})
    ranges = {r: (low, high, 0, n) for r in ranks}  # by rank: a range that holds it, the rows below the range and in it

    def wide(r: int) -> bool:
        return ranges[r][0] < ranges[r][1] and ranges[r][3] > held

    while open_ := sorted({ranges[r] for r in ranks if wide(r)}):
        cell = F.lit(None)
        for i, (low, high, _, _) in enumerate(open_):
            width = high / bins - low / bins
            part = F.least(F.floor((F.col("x") / bins - low / bins) / width * bins), F.lit(bins - 1)).cast("int") if width > 0 else (F.col("x") > low).cast("int")
            cell = F.when(F.col("x").between(low, high), F.struct(F.lit(i).alias("i"), part.alias("b"))).otherwise(cell)
        found = x.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("c is not null").collect()
        cells = {i: sorted((c for c in found if c["c"]["i"] == i), key=lambda c: c["low"]) for i in range(len(open_))}
        for r in ranks:
            if wide(r):
                i = open_.index(ranges[r])
                passed = ranges[r][2]
                for c in cells[i]:
                    if passed <= r < passed + c["n"]:
                        ranges[r] = (c["low"], c["high"], passed, c["n"])
                    passed += c["n"]
    values = {}
    for r, (low, high, below, _) in ranges.items():
        if low == high:
            values[r] = low
        else:  # `held` rows at most
            values[r] = sorted(v["x"] for v in x.where(F.col("x").between(low, high)).collect())[r - below]
    first, last = values[ranks[0]], values[ranks[-1]]
    return first + (last - first) * (at - int(at))


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with missing values of the columns replaced by the columns' medians."""
    medians = {c: quantile(rows, c, 0.5) for c in columns}
    return rows.select(*[F.coalesce(c, F.lit(medians[c]).cast(rows.schema[c].dataType)).alias(c) if c in columns else c for c in rows.columns])


def bridged(forecasts: DataFrame, trades: DataFrame, key: str, picked: str, at: str, take: dict[str, str]) -> DataFrame:
    """key, action and the columns `take` of each key's earliest trade (of equals the smallest).

    A forecast without a pick of its own takes the trade (bridged), others are kept, and trades of keys
    without a forecast are appended.
    """
    first = F.min(F.struct(at, *take.values())).alias("__t")
    early = trades.groupBy(key).agg(first).select(key, "__t", F.lit(True).alias("__in"))
    both = forecasts.select(key, picked, F.lit(True).alias("__held")).join(early, key, "full")
    new, open_ = F.col("__held").isNull(), ~F.coalesce(F.col(picked), F.lit(False))
    action = F.when(new, "appended").when(open_ & F.col("__in").isNotNull(), "bridged").otherwise("kept")
    return both.select(key, action.alias("action"), *[F.when(new | open_, F.col(f"__t.{c}")).alias(n) for n, c in take.items()])
