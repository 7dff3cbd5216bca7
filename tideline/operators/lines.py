"""Assessment of two-way lines on a count: what the market says, what a model makes of it, and the pick worth taking.

A fixture's lines become rows, are priced as columns, and meet again in one aggregation: nothing but the
distribution's masses is an array, and no line waits for another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, components, fair, logit, sigmoid

#: The market mean's variance on a logarithmic scale; the least edge; the trust in a model before it has earned another, and once it drifts; rows that earn it.
MARKET_VARIANCE, EDGE, TRUST, DRIFTING, EARNED = 0.006, 0.02, 0.55, 0.35, 30

#: Counts up to this one have masses of their own.
LAST = 60


def prior_weight(log_variance: Column, reliable: Column) -> Column:
    """The weight of a prior mean beside the market's, by their precisions; 0 if it is not reliable."""
    precision = 1 / F.greatest(log_variance, F.lit(1e-6))
    return F.when(F.coalesce(reliable, F.lit(False)), precision / (precision + 1 / MARKET_VARIANCE)).otherwise(0.0)


def blended_mean(market: Column, prior: Column, log_variance: Column, reliable: Column) -> Column:
    """The market's mean drawn towards a prior one, on a logarithmic scale."""
    w = prior_weight(log_variance, reliable)
    return F.when((w > 0) & (prior > 0), F.exp((1 - w) * F.log(market) + w * F.log(prior))).otherwise(market)


def weather_dispersion(rain: Column, wind_kmh: Column) -> Column:
    """How much rain (a chance) and wind widen a count; 0 without a forecast."""
    return F.coalesce(0.018 * clip(rain, 0.0, 1.0) + 0.014 * clip(wind_kmh / 45, 0.0, 1.0), F.lit(0.0))


def trust(share: Column, settled: Column, drifting: Column, weight: Column) -> Column:
    """The part of a model's view that counts: what the anchor has learnt, less while its learner is young in weight, little while it drifts."""
    learnt = F.coalesce(share, F.lit(TRUST))
    young = settled.isNull() | (settled < EARNED)
    return F.when(young, learnt).when(drifting, F.least(F.lit(DRIFTING), learnt)).otherwise(clip(learnt * (0.35 + 0.65 * weight), 0.0, 1.0))


def masses(mean: Column, dispersion: Column, last: int = LAST) -> Column:
    """The masses of 0 .. last of a count with variance mean + dispersion * mean^2; a Poisson count without dispersion."""
    steps = F.sequence(F.lit(1), F.lit(last))
    poisson = F.aggregate(steps, F.array(F.exp(-mean)), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * mean / k)))
    size = 1 / dispersion
    wide = F.aggregate(steps, F.array(F.exp(size * F.log(size / (size + mean)))), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * (k - 1 + size) / k * (mean / (size + mean)))))
    return F.when(dispersion > 1e-9, wide).otherwise(poisson)


def outcome(m: Column, line: Column) -> Column:
    """win, push, loss of the high side of a line; a quarter line is the mean of its two halves."""

    def one(c: Column) -> Column:
        whole = F.abs(c - F.round(c)) < 1e-9
        at = F.floor(c + 1e-9).cast("int")
        push = F.when(whole, F.coalesce(F.get(m, at), F.lit(0.0))).otherwise(0.0)
        below = F.aggregate(F.slice(m, F.lit(1), F.greatest(F.when(whole, at).otherwise(at + 1), F.lit(0))), F.lit(0.0), lambda a, x: a + x)
        return F.struct((1 - below - push).alias("win"), push.alias("push"), below.alias("loss"))

    parts = F.transform(components(line), one)
    mean = lambda k: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x[k]) / F.size(parts)
    return F.struct(*[mean(k).alias(k) for k in ("win", "push", "loss")])


def adjusted(o: Column) -> Column:
    """The chance of winning with half of what is returned, by which lines compare."""
    return o["win"] + o["push"] / 2


def moved(o: Column, target: Column) -> Column:
    """The outcome with its adjusted chance moved to a target, as far as what is not returned allows."""
    decisive = o["win"] + o["loss"]
    share = clip((target - o["push"] / 2) / decisive, 0.0, 1.0)
    return F.when(decisive > 0, F.struct((share * decisive).alias("win"), o["push"].alias("push"), ((1 - share) * decisive).alias("loss"))).otherwise(o)


def assessed(fixtures: DataFrame, id_: str = "id", calibrate: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row a line that both sides price: id_, place, line, status, high_odds, low_odds, fair_high, overround, raw, calibrated, high, push, high_edge, low_edge, mean.

    fixtures: id_, market_mean, prior_mean, prior_variance, reliable, dispersion, trust, residual_bias, residual_weight,
    adopted, and lines, an array of (line, status, high_odds, low_odds). calibrate maps a chance; an adopted residual corrects the
    market's by it, else it is drawn to the market's by trust. Fixtures without mean or lines have no row.
    """
    f = fixtures.where("market_mean > 0").withColumn("mean", blended_mean(F.col("market_mean"), F.col("prior_mean"), F.col("prior_variance"), F.col("reliable")))
    f = f.withColumn("__m", masses(F.col("mean"), F.coalesce("dispersion", F.lit(0.0))))
    rows = f.select("*", F.posexplode("lines").alias("place", "__l")).select("*", "__l.*").where("high_odds > 1 and low_odds > 1")
    rows = rows.withColumns({"fair_high": fair(F.col("high_odds"), F.col("low_odds"))[0], "overround": 1 / F.col("high_odds") + 1 / F.col("low_odds") - 1, "__o": outcome(F.col("__m"), F.col("line"))})
    rows = rows.withColumn("__c", moved(F.col("__o"), calibrate(adjusted(F.col("__o")))) if calibrate else F.col("__o"))
    gap = clip(logit(adjusted(F.col("__c"))) - logit(F.col("fair_high")), -2.0, 2.0)
    fixed = clip(sigmoid(logit(F.col("fair_high")) + F.col("residual_bias") + F.col("residual_weight") * gap), 0.0, 1.0)
    part = F.coalesce("trust", F.lit(TRUST))
    drawn = F.when(part >= 1, F.col("__c")).otherwise(moved(F.col("__c"), F.col("fair_high") + part * (adjusted(F.col("__c")) - F.col("fair_high"))))
    rows = rows.withColumn("__h", F.when(F.coalesce("adopted", F.lit(False)), moved(F.col("__c"), fixed)).otherwise(drawn))
    h = F.col("__h")
    return rows.select(
        id_, "place", "line", "status", "high_odds", "low_odds", "fair_high", "overround", adjusted(F.col("__o")).alias("raw"), adjusted(F.col("__c")).alias("calibrated"), adjusted(h).alias("high"), h["push"].alias("push"),
        (h["win"] * (F.col("high_odds") - 1) - h["loss"]).alias("high_edge"), (h["loss"] * (F.col("low_odds") - 1) - h["win"]).alias("low_edge"), "mean",
    )


def line_confidence(edge: Column, gap: Column, lines: Column, overround: Column, agrees: Column, drifting: Column, audited: Column) -> Column:
    """0 to 1 by edge, agreement of the lines with the market, their number, the margin and the prior; capped while the learner drifts or nobody has audited it."""
    unit = lambda c: clip(c, 0.0, 1.0)
    raw = 0.40 * unit(edge / 0.10) + 0.22 * unit(1 - gap / 0.05) + 0.13 * unit((lines - 1) / 3) + 0.13 * unit(1 - overround / 0.10) + 0.12 * F.when(agrees, 1.0).otherwise(0.0)
    return F.when(F.coalesce(drifting, F.lit(False)), F.least(raw, F.lit(0.30))).when(F.coalesce(audited, F.lit(False)), raw).otherwise(F.least(raw, F.lit(0.39)))


def picks(fixtures: DataFrame, id_: str = "id", calibrate: Callable[[Column], Column] | None = None, edge: float = EDGE) -> DataFrame:
    """A row a fixture with a priced line: id_, mean, lines, gap, overround, kind (pick or watch), line, direction, odds, edge, probability, confidence, required.

    A pick is the available side of the largest edge above 0 and not below `edge`, of equals the first line's high side; it needs
    a fixture that is not suspended. Without one the best available side is watched, and required is the chance that would
    make it a pick. kind is null where no line is available. fixtures: as assessed(), with suspended, drifting and audited.
    """
    rows = assessed(fixtures, id_, calibrate)
    side = lambda high: F.struct(F.col(f"{'high' if high else 'low'}_edge").alias("edge"), (-F.col("place")).alias("place"), F.lit(int(high)).alias("is_high"), "line", F.col(f"{'high' if high else 'low'}_odds").alias("odds"), (F.col("high") if high else 1 - F.col("high")).alias("p"), "push")
    open_ = F.when(F.col("status") == "AVAILABLE", F.greatest(side(True), side(False)))
    off = F.col("high") - F.col("fair_high")
    g = rows.groupBy(id_).agg(F.first("mean").alias("mean"), F.count("*").alias("lines"), F.sqrt(F.avg(off * off)).alias("gap"), F.avg("overround").alias("overround"), F.max(open_).alias("b"))
    more = fixtures.select(id_, "market_mean", "prior_mean", F.coalesce("reliable", F.lit(False)).alias("reliable"), F.coalesce("suspended", F.lit(False)).alias("suspended"), "drifting", "audited")
    g = g.join(more, id_)
    b = F.col("b")
    taken = ~F.col("suspended") & (b["edge"] > 0) & (b["edge"] >= edge)
    apart = F.col("prior_mean") - F.col("market_mean")
    agrees = F.col("reliable") & F.when(b["is_high"] == 1, apart > 0.15).otherwise(apart < -0.15)
    confidence = line_confidence(b["edge"], F.col("gap"), F.col("lines"), F.col("overround"), agrees, F.col("drifting"), F.col("audited"))
    required = clip((1 + edge - b["push"] * (1 - b["odds"] / 2)) / F.greatest(b["odds"], F.lit(1e-6)), 0.0, 1.0)
    return g.select(
        id_, "mean", "lines", "gap", "overround", F.when(b.isNotNull(), F.when(taken, "pick").otherwise("watch")).alias("kind"), b["line"].alias("line"), F.when(b["is_high"] == 1, "high").when(b.isNotNull(), "low").alias("direction"),
        b["odds"].alias("odds"), b["edge"].alias("edge"), b["p"].alias("probability"), F.when(b.isNotNull(), confidence).alias("confidence"), F.when(b.isNotNull() & ~taken, required).alias("required"),
    )


def half_lines(rows: DataFrame, key: str, prefix: str, line: str = "line") -> DataFrame:
    """Rows of keys that begin with a prefix, on half lines."""
    return rows.where(F.col(key).startswith(prefix) & (F.pmod(F.col(line), F.lit(1.0)) == 0.5))


def alerts(rows: DataFrame, model: str, market: str, edge: float = 0.05) -> DataFrame:
    """Rows whose model's chance beats the market's by so much, with edge, the largest first."""
    gap = F.col(model) - F.col(market)
    return rows.withColumn("edge", gap).where((F.col("edge") > 0) & (F.col("edge") >= edge)).orderBy(F.desc("edge"))


def open_first(trades: DataFrame, keys: list[str], settled: str, event: str, created: str) -> DataFrame:
    """trades with place: within keys the open ones first, then by event and creation, newest first."""
    return trades.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(settled).isNull().desc(), F.desc(event), F.desc(created))))
