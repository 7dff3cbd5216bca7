"""Strengths that drift: Kalman steps between which a state reverts towards the average.

`levels` filters one state a key. Its steps compose: with P = X / Y and m = M / Y, a day's reversion and
its observations are one linear map of (X, Y, M). A key's observations are first added up by day, days
are cut into blocks, each block's maps multiply into one map of seven numbers, a key's blocks are walked
once, and then all blocks filter their days at the same time from where they begin. A key that holds a
large share of all rows thus costs one row a day, and its blocks are spread over the tasks.

`strengths` is the coupled case: a match moves four states of two teams, by steps that are not linear in
them, so a league's matches are one ordered fold (see folds.py).
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold

#: The variance of a state about which nothing is known, and the days within which it forgets.
VARIANCE, REVERSION = 0.03, 260.0


def _scan(items: Column, state: Column, step, out) -> Column:
    """What out(state, item) gives for each item of an array, the state moving by step(state, item)."""
    first = F.struct(state.alias("s"), F.transform(F.slice(items, 1, 0), lambda x: out(state, x)).alias("o"))
    return F.aggregate(items, first, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["o"], F.array(out(a["s"], x))).alias("o")), lambda a: a["o"])


def levels(rows: DataFrame, keys: list[str], day: str, value: Column, noise: Column, variance: float = VARIANCE, reversion: float = REVERSION, block: int = 64) -> DataFrame:
    """keys, day, and a key's state before and after the day: prior_mean, prior_variance, mean, variance.

    value: an observation of the state; noise: its variance. A state begins at 0 with `variance`, and
    between days reverts to that: its mean times exp(-days / reversion). Null values, noises that are not
    positive and null days are left out; a null key is a key.
    """
    seen = rows.select(*keys, F.col(day).cast("long").alias("__d"), value.cast("double").alias("__z"), noise.cast("double").alias("__r")).where("__d is not null and __z is not null and __r > 0")
    daily = seen.groupBy(*keys, "__d").agg(F.sum(1 / F.col("__r")).alias("h"), F.sum(F.col("__z") / F.col("__r")).alias("u"))
    item = F.struct(F.col("__d").alias("d"), "h", "u")
    blocks = daily.groupBy(*keys, F.floor(F.col("__d") / block).cast("long").alias("__b")).agg(F.sort_array(F.collect_list(item)).alias("__days"))  # `block` items at most

    keep = lambda gap: F.exp(-F.greatest(gap, F.lit(0)).cast("double") / reversion)
    spread = lambda p, gap: keep(gap) * keep(gap) * p + (1 - keep(gap) * keep(gap)) * variance

    def compose(s: Column, x: Column) -> Column:
        # X, Y and M as sums over what X0, Y0 (and M0) were; scaled, as only their ratios count
        gap = x["d"] - s["d"]
        x0, x1 = keep(gap) * keep(gap) * s["x0"] + (1 - keep(gap) * keep(gap)) * variance * s["y0"], keep(gap) * keep(gap) * s["x1"] + (1 - keep(gap) * keep(gap)) * variance * s["y1"]
        y0, y1 = s["y0"] + x["h"] * x0, s["y1"] + x["h"] * x1
        size = y0 + y1
        parts = {"x0": x0, "x1": x1, "y0": y0, "y1": y1, "m0": keep(gap) * s["m0"] + x["u"] * x0, "m1": keep(gap) * s["m1"] + x["u"] * x1, "g": keep(gap) * s["g"]}
        return F.struct(x["d"].alias("d"), *[(v / size).alias(k) for k, v in parts.items()])

    one, zero = F.lit(1.0), F.lit(0.0)
    same = F.struct(F.element_at("__days", 1)["d"].alias("d"), one.alias("x0"), zero.alias("x1"), zero.alias("y0"), one.alias("y1"), zero.alias("m0"), zero.alias("m1"), one.alias("g"))
    maps = blocks.select(*keys, "__b", F.element_at("__days", 1)["d"].alias("first"), F.aggregate("__days", same, compose).alias("map"))

    def apply(s: Column, x: Column) -> Column:
        gap = x["first"] - s["d"]
        p, m, f = spread(s["p"], gap), keep(gap) * s["m"], x["map"]
        y = f["y0"] * p + f["y1"]
        return F.struct(f["d"].alias("d"), ((f["m0"] * p + f["m1"] + f["g"] * m) / y).alias("m"), ((f["x0"] * p + f["x1"]) / y).alias("p"))

    # a key's blocks: as many as its calendar has, however many rows there are
    walked = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "first", "map"))).alias("__all"))
    begin = F.struct(F.element_at("__all", 1)["first"].alias("d"), zero.alias("m"), F.lit(variance).alias("p"))
    entries = walked.select(*keys, F.explode(_scan(F.col("__all"), begin, apply, lambda s, x: F.struct(x["__b"].alias("__b"), s.alias("entry")))).alias("e"))
    entries = entries.select(*[F.struct(F.col(k).alias("v")).alias(f"__{k}") for k in keys], F.col("e.__b").alias("__b"), F.col("e.entry").alias("entry"))  # in a struct, null equals null
    wrapped = blocks.select(*keys, "__b", "__days", *[F.struct(F.col(k).alias("v")).alias(f"__{k}") for k in keys])

    def observe(s: Column, x: Column) -> Column:
        p = spread(s["p"], x["d"] - s["d"])
        return F.struct(x["d"].alias("d"), ((keep(x["d"] - s["d"]) * s["m"] + x["u"] * p) / (1 + x["h"] * p)).alias("m"), (p / (1 + x["h"] * p)).alias("p"))

    def told(s: Column, x: Column) -> Column:
        after = observe(s, x)
        return F.struct(x["d"].alias("d"), (keep(x["d"] - s["d"]) * s["m"]).alias("m0"), spread(s["p"], x["d"] - s["d"]).alias("p0"), after["m"].alias("m1"), after["p"].alias("p1"))

    out = wrapped.join(entries, [*[f"__{k}" for k in keys], "__b"]).select(*keys, F.explode(_scan(F.col("__days"), F.col("entry"), observe, told)).alias("x"))
    return out.select(*keys, F.col("x.d").alias(day), F.col("x.m0").alias("prior_mean"), F.col("x.p0").alias("prior_variance"), F.col("x.m1").alias("mean"), F.col("x.p1").alias("variance"))


def strengths(
    matches: DataFrame, home: float = 5.5, away: float = 4.8, weight: float = 4.0, most: float = 300.0, support: float = 0.55,
    variance: float = VARIANCE, reversion: float = REVERSION, least: int = 30, known: float = 6.0, sure: float = 0.05,
) -> DataFrame:
    """Of every match what was to be expected of it the day before: id, home_mean, away_mean, log_variance, dispersion, team_matches, reliable.

    matches: league, day, id, home, away, home_n, away_n (null: not played yet, it teaches nothing), top
    (false: a match of the support division, which counts less and leaves the league's means alone). Each
    team has an attack and a defence about 0, on a logarithmic scale, with variances; a match is one step
    for both pairs of them, by how uncertain each is. All of a day's rows are told what held before it; null
    means: a team that had not played. Rows without league, day or team are told nothing and teach nothing.
    """

    def begin() -> dict:
        return {"day": None, "teams": {}, "opened": {}, "home": home, "away": away, "weight": weight, "n": 0, "excess": 0.0, "before": (home, away, 0, 0.0)}

    def reverted(t: tuple, day: int) -> tuple:
        days = min(max(day - t[5], 0), 400)
        keep = math.exp(-days / reversion)
        spread = (1 - keep * keep) * variance
        return t[0] * keep, t[1] * keep, keep * keep * t[2] + spread, keep * keep * t[3] + spread, t[4], t[5]

    def step(s: dict, r: Any) -> list[tuple]:
        if r.home is None or r.away is None or r.day != r.day:
            return [(r.id, None, None, None, None, None, False)]
        if r.day != s["day"]:
            s.update(day=r.day, opened={}, before=(s["home"], s["away"], s["n"], s["excess"]))
        teams, opened = s["teams"], s["opened"]
        then = [opened.get(t, teams.get(t)) for t in (r.home, r.away)]
        out = (r.id, None, None, None, None, None, False)
        if None not in then:
            league_home, league_away, n, excess = s["before"]
            (a0, d0, va0, vd0, m0, _), (a1, d1, va1, vd1, m1, _) = (reverted(t, r.day) for t in then)
            x, y = league_home * math.exp(a0 + d1), league_away * math.exp(a1 + d0)
            part = x / max(x + y, 1e-6), y / max(x + y, 1e-6)
            log_variance = part[0] ** 2 * (va0 + vd1) + part[1] ** 2 * (va1 + vd0)
            out = (r.id, x, y, log_variance, max(excess / n, 0.0) if n >= least else 0.0, min(m0, m1), min(m0, m1) >= known and log_variance < sure)
        if r.home_n != r.home_n or r.away_n != r.away_n or r.home_n is None or r.away_n is None:
            return [out]
        for t in (r.home, r.away):
            opened.setdefault(t, teams.get(t))
        fresh = (0.0, 0.0, variance, variance, 0.0, r.day)
        (a0, d0, va0, vd0, m0, _), (a1, d1, va1, vd1, m1, _) = (reverted(teams.get(t, fresh), r.day) for t in (r.home, r.away))
        x, y = s["home"] * math.exp(a0 + d1), s["away"] * math.exp(a1 + d0)
        w = 1.0 if r.top else support
        if r.top:
            mu = max(x + y, 1e-3)
            s["n"], s["excess"] = s["n"] + 1, s["excess"] + ((r.home_n + r.away_n - mu) ** 2 - mu) / mu**2
            s["home"] = (s["home"] * s["weight"] + r.home_n) / (s["weight"] + 1)
            s["away"] = (s["away"] * s["weight"] + r.away_n) / (s["weight"] + 1)
            s["weight"] = min(s["weight"] + 1, most)
        a0, d1, va0, vd1 = moved(a0, d1, va0, vd1, x, r.home_n, w)
        a1, d0, va1, vd0 = moved(a1, d0, va1, vd0, y, r.away_n, w)
        teams[r.home], teams[r.away] = (a0, d0, va0, vd0, m0 + w, r.day), (a1, d1, va1, vd1, m1 + w, r.day)
        return [out]

    def moved(a: float, d: float, va: float, vd: float, expected: float, n: float, w: float) -> tuple:
        surprise = math.log((n + 0.5) / (max(expected, 0.2) + 0.5))
        total = va + vd + 1 / max(expected, 0.5) / max(w, 1e-3)
        return a + va / total * surprise, d + vd / total * surprise, va * (1 - va / total), vd * (1 - vd / total)

    rows = matches.select("league", "day", "id", "home", "away", F.col("home_n").cast("double").alias("home_n"), F.col("away_n").cast("double").alias("away_n"), "top")
    schema = "id long, home_mean double, away_mean double, log_variance double, dispersion double, team_matches double, reliable boolean"
    return fold(rows, ["league"], ["day", "id"], schema, begin, step)
