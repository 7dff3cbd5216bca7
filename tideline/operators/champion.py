"""A baseline, a challenger, and two gates between them.

Races are split in order of time. A challenger that learnt from the earliest ones must beat the baseline on the
next; learnt again from both, it must beat it on the latest, which nothing has seen before and which is read
once. Winning is judged by the log loss of the winners, a place by the Brier score, each choice by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY
from .calibration import earliest
from .candidates import winner_classifier
from .models import together
from .places import paid
from .windows import capped, share, softmax

#: Where the races are cut; winners that either judging part needs, and rows that there must be; the baseline's weights.
CUTS, WINNERS, ROWS = (0.7, 0.85), 15, 500
BASELINE = {"horse_win_rate": 1.6, "horse_finish_score": 0.8, "jockey_win_rate": 0.55, "trainer_win_rate": 0.55, "recent_form_score": 0.35, "weight_norm": -0.12}

#: A learner: rows, features, target and the race to a function that adds the column __raw, a positive score.
Learner = Callable[[DataFrame, list[str], str, str], Callable[[DataFrame], DataFrame]]


def baseline(race: str, weights: dict[str, float] = BASELINE) -> Column:
    """Chances of winning by a fixed score, made to sum to 1 in each race."""
    return softmax(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), [race])


def scaled(rows: DataFrame, features: list[str]) -> dict[str, Column]:
    """Features about 0 with deviation 1 over these rows; gaps count as the mean."""
    m = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    return {f"__{c}": F.coalesce((F.col(c) - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)}


def newton(terms: Callable[[list[float]], tuple[DataFrame, list[Column], list[list[Column]]]], k: int, ridge: float, steps: int = 20) -> list[float]:
    """Weights of the least loss with a ridge, by Newton's method: an aggregation a step.

    terms: from weights to rows, the gradient's and the upper half of the Hessian's terms of a row.
    """
    w = [0.0] * k
    for _ in range(steps):
        frame, slope, bend = terms(w)
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        r = frame.agg(*[F.sum(c) for c in slope], *[F.sum(bend[i][j]) for i, j in cells]).first()
        g = np.array([x or 0.0 for x in r[:k]]) + ridge * np.array(w)
        h = ridge * np.eye(k)
        for (i, j), x in zip(cells, r[k:], strict=True):
            h[i, j] += x or 0.0
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, g)
        step = step / max(1.0, float(np.abs(step).max()) / 4)
        w = (np.array(w) - step).tolist()
        if np.abs(step).max() < 1e-9:
            break
    return w


def by_choice(rows: DataFrame, features: list[str], target: str, race: str, l2: float = 0.004) -> Callable[[DataFrame], DataFrame]:
    """Learns who wins a race by a softmax over its runners; l2: the ridge of a race's loss."""
    columns = scaled(rows, features)
    x, g = list(columns), Window.partitionBy(race)
    lain = together(rows.withColumns(columns).select(race, *x, target), race)

    def terms(w: list[float]) -> tuple[DataFrame, list[Column], list[list[Column]]]:
        u = sum((F.col(c) * v for c, v in zip(x, w, strict=True)), F.lit(0.0))
        f = lain.withColumn("__p", softmax(u, [race])).withColumns({f"{c}m": F.sum(F.col("__p") * F.col(c)).over(g) for c in x})
        off = [F.col(c) - F.col(f"{c}m") for c in x]
        return f, [(F.col("__p") - F.col(target)) * F.col(c) for c in x], [[F.col("__p") * a * b for b in off] for a in off]

    try:
        w = newton(terms, len(x), l2 * max(lain.select(race).distinct().count(), 1))
    finally:
        lain.unpersist()
    return lambda new: new.withColumn("__raw", F.exp(sum((c * v for c, v in zip(columns.values(), w, strict=True)), F.lit(0.0))))


def by_odds(rows: DataFrame, features: list[str], target: str, race: str, l2: float = 0.004) -> Callable[[DataFrame], DataFrame]:
    """Learns each runner's own chance; l2: the ridge of a row's loss."""
    columns = scaled(rows, features)
    x = ["__one", *columns]
    lain = rows.withColumns({"__one": F.lit(1.0)} | columns).select(*x, target).persist()

    def terms(w: list[float]) -> tuple[DataFrame, list[Column], list[list[Column]]]:
        p = 1 / (1 + F.exp(-sum((F.col(c) * v for c, v in zip(x, w, strict=True)), F.lit(0.0))))
        f = lain.withColumn("__p", p)
        bend = F.col("__p") * (1 - F.col("__p"))
        return f, [(F.col("__p") - F.col(target)) * F.col(c) for c in x], [[bend * F.col(a) * F.col(b) for b in x] for a in x]

    try:
        w = newton(terms, len(x), l2 * max(lain.count(), 1))
    finally:
        lain.unpersist()
    u = sum((c * v for c, v in zip(columns.values(), w[1:], strict=True)), F.lit(w[0]))
    return lambda new: new.withColumn("__raw", 1 / (1 + F.exp(-u)))


def by_trees(trees: int = 140) -> Learner:
    """Learns by boosted trees; the rows need the column race."""

    def learn(rows: DataFrame, features: list[str], target: str, race: str) -> Callable[[DataFrame], DataFrame]:
        model = winner_classifier(rows.fillna(0.0, features), features, target, trees)
        return lambda new: model(new.fillna(0.0, features)).withColumnRenamed("p", "__raw")

    return learn


def parts(rows: DataFrame, race: str, day: str) -> DataFrame:
    """rows with __part: development, validation or holdout, by races in order of time."""
    races = rows.groupBy(race).agg((F.min(day) * F.lit(DAY)).alias("__t"))
    for i, cut in enumerate(CUTS):
        races = earliest(races, [], "__t", race, cut, f"__cut{i}").drop("__n")
    part = F.when(F.col("__cut0"), "development").when(F.col("__cut1"), "validation").otherwise("holdout")
    return rows.join(races.select(race, part.alias("__part")), race)


def judged(rows: DataFrame, race: str, won: str, placed: str, place_rate: str, win: Callable, place: Callable) -> dict[str, float]:
    """Losses of the challenger and the baseline on some rows, in one pass over them."""
    rows = win(rows).withColumn("__win", share(F.col("__raw"), [race])).drop("__raw").withColumn("__base", baseline(race))
    rows = place(rows).withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(race))).withColumn("__slots", paid(F.col("__size")).cast("double"))
    rows = rows.withColumns({"__place": share(F.col("__raw"), [race]) * F.col("__slots"), "__rate": share(F.col(place_rate).cast("double"), [race]) * F.col("__slots")})
    loss = lambda c: F.avg(F.when(F.col(won) == 1, -F.log(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(1e-8)))))
    brier = lambda c: F.avg(F.pow(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) - F.col(placed), F.lit(2.0)))
    r = rows.agg(loss("__win").alias("win"), loss("__base").alias("baseline_win"), brier("__place").alias("place"), brier("__rate").alias("baseline_place"), F.sum(won).alias("winners"), F.count_distinct(race).alias("races")).first()
    return r.asDict()


def trained(rows: DataFrame, features: list[str], race: str, day: str, won: str, placed: str, place_rate: str, win: Learner = by_choice, place: Learner = by_odds) -> tuple[dict, Callable[[DataFrame], DataFrame]]:
    """What the gates have decided, with the figures, and a function from rows to rows with win and place, each race's chances.

    rows: a runner a row, of races that have been run, with features, the baseline's columns, and place_rate, the share of
    earlier places by which the baseline places. ValueError with too few rows, or winners to judge by.
    """
    rows = parts(rows, race, day).persist()
    try:
        if rows.count() < ROWS:
            raise ValueError(f"{ROWS} rows at least are needed")
        development, validation, holdout = (rows.where(F.col("__part") == p).drop("__part") for p in ("development", "validation", "holdout"))
        first = judged(validation, race, won, placed, place_rate, win(development, features, won, race), place(development, features, placed, race))
        if (first["winners"] or 0) < WINNERS:
            raise ValueError("too few winners to judge by")
        earlier = rows.where("__part <> 'holdout'").drop("__part")
        last = judged(holdout, race, won, placed, place_rate, win(earlier, features, won, race), place(earlier, features, placed, race))
        if (last["winners"] or 0) < WINNERS:
            raise ValueError("too few winners to judge by")
        passed = {k: (first[k] < first[f"baseline_{k}"], first[k] < first[f"baseline_{k}"] and last[k] < last[f"baseline_{k}"]) for k in ("win", "place")}
        figures = {
            "win": "challenger" if passed["win"][1] else "baseline", "place": "challenger" if passed["place"][1] else "baseline",
            "validation_win": "challenger" if passed["win"][0] else "baseline", "validation_place": "challenger" if passed["place"][0] else "baseline",
            "win_loss": last["win"] if passed["win"][1] else last["baseline_win"], "baseline_win_loss": last["baseline_win"],
            "place_brier": last["place"] if passed["place"][1] else last["baseline_place"], "baseline_place_brier": last["baseline_place"],
            "validation_races": first["races"], "holdout_races": last["races"],
        }
        every = rows.drop("__part")
        of_win = win(every, features, won, race) if passed["win"][1] else None
        of_place = place(every, features, placed, race) if passed["place"][1] else None
    finally:
        rows.unpersist()

    def predict(new: DataFrame) -> DataFrame:
        out = of_win(new).withColumn("win", share(F.col("__raw"), [race])).drop("__raw") if of_win else new.withColumn("win", baseline(race))
        out = of_place(out) if of_place else out.withColumn("__raw", F.col(place_rate).cast("double"))
        out = out.withColumn("__slots", paid(F.count(F.lit(1)).over(Window.partitionBy(race))).cast("double")).withColumn("place", share(F.col("__raw"), [race]))
        return capped(out, "place", [race], F.col("__slots"), most=1.0).select(*new.columns, "win", "place")

    return figures, predict


def assembled(predicted: DataFrame, race: list[str], runner: list[str], order: str = "win") -> DataFrame:
    """race, and runners: an array of (runner, win, place), the likeliest winner first; of equals as their columns say."""
    one = F.struct((-F.col(order)).alias("__o"), *runner, *[F.round(c, 6).alias(c) for c in ("win", "place")])
    g = predicted.groupBy(*race).agg(F.sort_array(F.collect_list(one)).alias("runners"))  # a race's runners
    return g.withColumn("runners", F.transform("runners", lambda r: r.dropFields("__o")))
