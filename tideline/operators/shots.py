"""Counts expected in two stages, shots and what comes of them, and counts adjusted for the opponent.

`two_stage` is an ordered fold (folds.py): a match moves three states of each team towards what it showed
against that opponent. `adjusted` needs no fold: it looks at both sides' pasts, day by day.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import league_means, past, recency_mean, sides
from .folds import fold
from .joins import beside

#: Matches within which a state forgets half, matches that a state is drawn to 0 by, variances of the stages, days of reversion, judges' matches.
HALF_LIFE, SHRINK, SHOT_VARIANCE, RATE_VARIANCE, REVERSION, JUDGED, JUDGE_SHRINK = 26.0, 8.0, 0.020, 0.016, 260.0, 12, 25.0

#: A league's shots and counts before any match.
START = {"home_shots": 13.5, "away_shots": 11.5, "home_n": 5.5, "away_n": 4.8}


def two_stage(matches: DataFrame, support: float = 0.55, weight: float = 4.0, most: float = 300.0, least: int = 30) -> DataFrame:
    """Of every match what was to be expected of it the day before: id, home_mean, away_mean, log_variance, dispersion, team_matches.

    matches: league, day, id, home, away, home_n, away_n, home_shots, away_shots (null or 0: teaches nothing), judge, top
    (false: a match of the support division). Shots by attack and defence, counts by a rate of the shots, times a judge's
    factor once they have JUDGED matches. Null where a team had not played; rows without league, day or team are told and teach nothing.
    """
    gain = 1 - 0.5 ** (1 / HALF_LIFE)

    def begin() -> dict:
        return {"day": None, "teams": {}, "judges": {}, "opened": {}, "called": {}, "league": dict(START), "weight": weight, "n": 0, "excess": 0.0, "before": None}

    def shrunk(t: tuple, day: int) -> tuple:
        part = t[3] / (t[3] + SHRINK) * math.exp(-min(max(day - t[4], 0), 400) / REVERSION)
        return t[0] * part, t[1] * part, t[2] * part, t[3]

    def moved(t: tuple, o: tuple, shots: float, against: float, n: float, league: tuple[float, float, float], w: float, day: int) -> tuple:
        own, other, rate = league
        by = w * gain
        attack = math.log(max(shots, 0.5) / max(own, 0.5)) - o[1]
        defence = math.log(max(against, 0.5) / max(other, 0.5)) - o[0]
        turned = math.log((n + 0.5) / (max(shots, 0.5) * rate + 0.5))
        return t[0] + by * (attack - t[0]), t[1] + by * (defence - t[1]), t[2] + by * (turned - t[2]), t[3] + w, day

    def step(s: dict, r: Any) -> list[tuple]:
        if r.home is None or r.away is None or r.day != r.day:
            return [(r.id, None, None, None, None, None)]
        if r.day != s["day"] or s["before"] is None:
            s.update(day=r.day, opened={}, called={}, before=(dict(s["league"]), s["n"], s["excess"]))
        g, n, excess = s["before"]
        then = [s["opened"].get(t, s["teams"].get(t)) for t in (r.home, r.away)]
        out = (r.id, None, None, None, None, None)
        if None not in then:
            (a0, d0, c0, m0), (a1, d1, c1, m1) = (shrunk(t, r.day) for t in then)
            total, judged = s["called"].get(r.judge, s["judges"].get(r.judge, (0.0, 0))) if r.judge is not None else (0.0, 0)
            factor = math.exp(total / (judged + JUDGE_SHRINK)) if judged >= JUDGED else 1.0
            home_rate, away_rate = g["home_n"] / max(g["home_shots"], 1e-3), g["away_n"] / max(g["away_shots"], 1e-3)
            weakest = min(m0, m1)
            variance = (SHOT_VARIANCE + RATE_VARIANCE) * (1 - weakest / (weakest + SHRINK) * 0.85)
            out = (r.id, g["home_shots"] * math.exp(a0 + d1) * home_rate * math.exp(c0) * factor, g["away_shots"] * math.exp(a1 + d0) * away_rate * math.exp(c1) * factor, variance, max(excess / n, 0.0) if n >= least else 0.0, weakest)
        told = (r.home_n, r.away_n, r.home_shots, r.away_shots)
        if any(x is None or x != x for x in told) or not (r.home_shots > 0 and r.away_shots > 0):
            return [out]
        teams, w = s["teams"], 1.0 if r.top else support
        for t in (r.home, r.away):
            s["opened"].setdefault(t, teams.get(t))
        new = (0.0, 0.0, 0.0, 0.0, r.day)
        home, away = teams.get(r.home, new), teams.get(r.away, new)
        league = s["league"]
        if r.top:
            x = league["home_n"] / max(league["home_shots"], 1e-3) * league["home_shots"] * math.exp(home[0] + away[1] + home[2])
            y = league["away_n"] / max(league["away_shots"], 1e-3) * league["away_shots"] * math.exp(away[0] + home[1] + away[2])
            mu = max(x + y, 1e-3)
            s["n"], s["excess"] = s["n"] + 1, s["excess"] + ((r.home_n + r.away_n - mu) ** 2 - mu) / mu**2
            for c in START:
                league[c] = (league[c] * s["weight"] + getattr(r, c)) / (s["weight"] + 1)
            s["weight"] = min(s["weight"] + 1, most)
            if r.judge is not None:
                total, judged = s["judges"].get(r.judge, (0.0, 0))
                s["called"].setdefault(r.judge, (total, judged))
                s["judges"][r.judge] = (total + math.log((r.home_n + r.away_n + 0.5) / (max(league["home_n"] + league["away_n"], 0.5) + 0.5)), judged + 1)
        hs, as_ = league["home_shots"], league["away_shots"]
        now = moved(home, away, r.home_shots, r.away_shots, r.home_n, (hs, as_, league["home_n"] / max(hs, 1e-3)), w, r.day)
        teams[r.away] = moved(away, now, r.away_shots, r.home_shots, r.away_n, (as_, hs, league["away_n"] / max(as_, 1e-3)), w, r.day)  # sees what the home team has just become
        teams[r.home] = now
        return [out]

    numbers = [F.col(c).cast("double").alias(c) for c in START]
    rows = matches.select("league", "day", "id", "home", "away", *numbers, "judge", "top")
    return fold(rows, ["league"], ["day", "id"], "id long, home_mean double, away_mean double, log_variance double, dispersion double, team_matches double", begin, step)


def quality(shots: Column, on_target: Column) -> Column:
    """A side's chances by its shots: those on target count more than the others. Null without both."""
    return F.when(shots.isNotNull() & on_target.isNotNull(), 0.32 * on_target + 0.09 * F.greatest(shots - on_target, F.lit(0)))


def adjusted(matches: DataFrame, k: int = 5, conceded: int = 20, low: float = 0.7, high: float = 1.4, support: float = 0.55, top: str = "E0") -> DataFrame:
    """id, team, scale, adjusted: by how much a side's count is scaled for its opponent, and its recency mean of scaled counts before the match.

    matches: id, day, division, home, away, home_n, away_n. The scale is the league's level over what the opponent has
    conceded in its last matches, within bounds, both before the day. The league's level is the top division's. Matches without day are left out.
    """
    weight = F.when(F.col("division") == top, 1.0).otherwise(support)
    each = sides(matches)
    league = league_means(matches.where(F.col("division") == top)).select("day", ((F.col("home") + F.col("away")) / 2).alias("level"))
    # the level as of each day: of a day without a match in the top division that of the next one, which has seen no more
    days = matches.select("day").distinct().join(league, "day", "left")
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)  # a row a day
    last = matches.where(F.col("division") == top)
    closing = _tail(last, "home_n", 5.5), _tail(last, "away_n", 4.8)
    days = days.select("day", F.coalesce(F.first("level", ignorenulls=True).over(ahead), F.lit((closing[0] + closing[1]) / 2)).alias("level"))
    leaked = past(each, ["team"], "day", "id", F.col("conceded"), conceded, weight).withColumnsRenamed({"past": "__leaked", "team": "opponent"})
    other = F.when(F.col("at_home"), F.col("away")).otherwise(F.col("home"))
    rows = each.join(matches.select("id", "home", "away"), "id").withColumn("opponent", other).drop("home", "away").join(days, "day")
    rows = beside(rows, leaked, ["opponent", "day"])
    given = recency_mean(F.col("__leaked"), F.col("level"))
    scale = F.greatest(F.lit(low), F.least(F.lit(high), F.col("level") / F.greatest(given, F.lit(0.5))))
    rows = rows.withColumn("scale", scale)
    before = past(rows, ["team"], "day", "id", F.col("scored") * F.col("scale"), k, weight)
    found = beside(rows.select("id", "day", "team", "scale", "level"), before, ["team", "day"])
    return found.select("id", "team", "scale", recency_mean(F.col("past"), F.col("level")).alias("adjusted"))


def _tail(rows: DataFrame, column: str, default: float, k: int = 100) -> float:
    """The mean of the last k values; the default without any."""
    got = rows.orderBy(F.desc("day"), F.desc("id")).limit(k).agg(F.avg(column)).first()[0]
    return default if got is None else got
