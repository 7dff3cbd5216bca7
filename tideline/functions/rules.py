"""Decision rules over columns: confidence, gates, race context, names and identities, validity of records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import clip

#: Short names of teams that feeds spell out.
ALIASES = {
    "manchester united": "man utd",
    "manchester city": "man city",
    "tottenham hotspur": "tottenham",
    "wolverhampton wanderers": "wolves",
    "newcastle united": "newcastle",
    "west ham united": "west ham",
    "brighton and hove albion": "brighton",
}

#: Combinations of 6 out of 49.
COMBINATIONS = 13_983_816


def translated(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """The name that a dictionary gives a value; the value itself, or a default, where it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value if default is None else default)


def alias(name: Column) -> Column:
    """A team's name in lower-case words of letters and digits, shortened where it is known."""
    return translated(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), ALIASES)


def referee(name: Column) -> Column:
    """A referee's name: letters only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z]+", " "))


def event_teams(event: Column) -> Column:
    """The two sides of an event's name, written with v or @; one element where it has no two."""
    return F.split(event, r"\s+(?:v|@)\s+", 2)


def corner_line(text: Column) -> Column:
    """The first number with a quarter, half or three quarters in a text about corners."""
    low = F.lower(text)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.when(low.contains("corner"), F.get(F.filter(numbers, lambda x: F.pmod(x, F.lit(1.0)).isin(0.25, 0.5, 0.75)), F.lit(0)))


def direction(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words])
    return F.when(has("over", "or more"), "over").when(has("under", "or less"), "under")


def entity_id(link: Column, name: Column) -> Column:
    """The id in a link, else that in brackets after a name, else the name itself in capitals."""
    linked = F.regexp_replace(F.nullif(F.regexp_extract(link, r"(?i)horseid=([^&]+)", 1), F.lit("")), "HK_", "")
    return F.coalesce(linked, F.nullif(F.regexp_extract(name, r"\(([A-Z]\d{3})\)", 1), F.lit("")), F.replace(F.upper(name), F.lit(" "), F.lit("_")))


def match_id(division: Column, day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws(":", division, F.date_format(day, "yyyy-MM-dd"), home, away)


def football_confidence(over: Column, width: Column, games: Column, promoted: Column, support: Column, calibration: Column, mae_skill: Column, brier_skill: Column) -> tuple[Column, Column]:
    """score and label of a forecast: how good its data are, how stable the model, how clear the side."""
    edge = F.abs(over - 0.5)
    interval, calibrated = clip(1 - F.greatest(width - 7, F.lit(0.0)) / 10, 0.2, 1.0), clip(1 - calibration / 0.08, 0.15, 1.0)
    worse = (mae_skill < 0) | (brier_skill < 0)
    stable = (0.45 * interval + 0.35 * calibrated + 0.2 * clip((games - 1) / 2.5, 0.15, 1.0)) * F.when(worse, 0.65).otherwise(1.0)
    score = 0.42 * clip(1 - 0.45 * support, 0.4, 1.0) + 0.38 * stable + 0.2 * clip(edge / 0.16, 0.1, 1.0)
    score = F.when(promoted > 0, F.least(score, F.lit(0.58))).otherwise(score)
    score = F.when(worse, F.least(score, F.lit(0.5))).otherwise(score)
    label = F.when((edge < 0.06) | (score < 0.52), "avoid").when((score >= 0.78) & (edge >= 0.14), "high").when((score >= 0.63) & (edge >= 0.09), "medium").otherwise("low")
    return score, label


def racing_confidence(p: Column, starts: Column, skill: Column, field: Column, baseline: Column) -> tuple[Column, Column]:
    """score and label of a runner: its edge over an even chance, its experience, the model's standing."""
    edge = F.greatest(p - 1 / F.greatest(field, F.lit(1)), F.lit(0.0))
    standing = F.when(baseline, 0.62).when(skill > 0, 0.75).otherwise(0.42)
    score = 0.45 * F.least(edge / 0.16, F.lit(1.0)) + 0.3 * F.least(starts / math.log1p(20), F.lit(1.0)) + 0.25 * standing
    score = F.when((skill <= 0) & ~baseline, F.least(score, F.lit(0.52))).otherwise(score)
    return score, F.when(score >= 0.76, "high").when(score >= 0.62, "medium").when(score >= 0.46, "low").otherwise("avoid")


def event_kind(missing: Column, voided: Column, shift: Column, drifted: Column, bar: float = 0.18) -> Column:
    """What a settled event may teach: the first of these that holds."""
    return F.when(voided, "void").when(missing, "data error").when(drifted, "model drift").when(F.abs(shift) >= bar, "market move").otherwise("healthy")


def wet(going: Column, rain_mm: Column) -> Column:
    named = F.upper(going).rlike("WET|SOFT|YIELDING|SLOW")
    return F.coalesce(named, F.lit(False)) | (F.coalesce(rain_mm, F.lit(0.0)) >= 1.0)


def race_uncertainty(going: Column, rain_mm: Column, humidity: Column, field: Column, known: Column) -> Column:
    """How much of a race the free data cannot describe, 0 to 1. known: whether there is a weather report."""
    parts = [
        F.when(wet(going, F.when(known, rain_mm)), 0.45), F.when(F.coalesce(going, F.lit("")) == "", 0.15), F.when(~known, 0.10),
        F.when(field >= 12, 0.20).when(field >= 10, 0.10), F.when(known & (humidity >= 0.90), 0.10),
    ]
    return clip(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), 0.0, 1.0)


def sprint_bias(starts: Column, metres: Column) -> Column:
    """Of a map from bands of 200 m to starts: shorter less longer ones than today's band, over both; 0 under three."""
    today = F.round(metres / 200)
    total = lambda keep: F.aggregate(F.map_values(F.map_filter(starts, lambda band, _: keep(band))), F.lit(0.0), lambda a, n: a + n)
    shorter, longer = total(lambda b: b < today), total(lambda b: b > today)
    return F.when(shorter + longer < 3, 0.0).otherwise((shorter - longer) / (shorter + longer))


def pace(leaders: Column, runners: Column) -> Column:
    """The scenario of a race from how many of its runners have a sprint bias above 0.34."""
    share = leaders / runners
    return F.when(runners < 4, "even").when(share >= 0.30, "fast").when(share <= 0.08, "slow").otherwise("even")


def pace_adjustment(scenario: Column, bias: Column) -> Column:
    bounded = clip(bias, -1.0, 1.0)
    return F.when(scenario == "fast", -0.09 * bounded).when(scenario == "slow", 0.09 * bounded).otherwise(0.0)


def draw_bias(venue: Column, metres: Column, draw: Column, field: Column) -> Column:
    """The log-utility of a barrier, inside stalls first; within 0.12."""
    place = (draw - 1) / F.greatest(field - 1, F.lit(1)) - 0.5
    valley, other = F.when(metres <= 1800, 0.24).otherwise(0.16), F.when(metres <= 1200, 0.20).when(metres <= 1650, 0.12).otherwise(0.06)
    strength = F.when(F.upper(venue) == "HV", valley).otherwise(other)
    return F.when(draw.isNull() | (draw <= 0) | (field < 4), 0.0).otherwise(clip(-strength * place, -0.12, 0.12))


def shortfall(suspended: Column, absent: Column, doubtful: Column) -> Column:
    """Players missing, doubtful ones half; of arrays."""
    return F.size(suspended) + F.size(absent) + 0.5 * F.size(doubtful)


def news_dispersion(missing: Column) -> Column:
    return F.when(missing > 0, clip(0.004 * missing, 0.0, 0.02)).otherwise(0.0)


def beats_baseline(mae: Column, baseline_mae: Column, brier: Column, baseline_brier: Column) -> Column:
    return (mae < baseline_mae) & (brier <= baseline_brier)


def gate_passed(folds: Column, passed: Column, beats: Column) -> Column:
    """A release needs three folds, most of them won, and the pooled scores."""
    return (folds >= 3) & (passed * 2 > folds) & beats


def signal(mae_delta: Column, brier_delta: Column) -> Column:
    """What leaving a feature out showed: it was useful, harmful, or neither (null)."""
    return F.when((mae_delta > 0.005) & (brier_delta >= 0), "useful").when(mae_delta < -0.005, "harmful")


def combined_prior(home: list[Column], total: list[Column], log_variance: list[Column]) -> tuple[Column, Column, Column]:
    """home, away, log variance of two means blended in log space by precision; the surer one splits the total."""
    w = [1 / F.greatest(v, F.lit(1e-6)) for v in log_variance]
    both = F.exp(sum((x * F.log(F.greatest(t, F.lit(1e-6))) for x, t in zip(w, total, strict=True)), F.lit(0.0)) / (w[0] + w[1]))
    share = [h / F.greatest(t, F.lit(1e-6)) for h, t in zip(home, total, strict=True)]
    part = F.when(log_variance[0] <= log_variance[1], share[0]).otherwise(share[1])
    return both * part, both * (1 - part), 1 / (w[0] + w[1])


def interval(mean: Column, lower: float, upper: float) -> tuple[Column, Column]:
    """Whole numbers about a mean, from 0, at least one apart."""
    low = F.greatest(F.ceil(mean + lower), F.lit(0)).cast("long")
    return low, F.greatest(F.floor(mean + upper), low + 1).cast("long")


def parimutuel(pool: Column, units: Column, crowd: Column, stake: float = 10.0) -> tuple[Column, Column, Column]:
    """expected co-winners, expected return, and its ratio to that of an even crowd."""
    others = units / COMBINATIONS * crowd
    expected, even = pool / (1 + others) / COMBINATIONS, pool / (1 + units / COMBINATIONS) / COMBINATIONS
    return others, expected - stake, F.when(even == 0, 1.0).otherwise(expected / even)


def shadow_valid(id_: Column, mean: Column, p: Column, market: Column, captured: Column, kick_off: Column, actual: Column, settled: Column) -> Column:
    """Whether a recorded forecast may be stored; repeated ids are for the caller to find."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = (F.length(id_) > 0) & finite(mean) & (mean >= 0) & (captured < kick_off) & (actual.isNull() == settled.isNull())
    ok = ok & (p.isNull() | (finite(p) & p.between(0, 1))) & (market.isNull() | (finite(market) & (market > 0) & (market < 1)))
    return F.coalesce(ok & (settled.isNull() | (settled >= kick_off)), F.lit(False))
