"""The record of forecasts: the quote that stood when each was made, the close, how it was settled, and what it all adds up to.

Quotes meet forecasts by match and line and, within those, as of a time (joins.asof). Nothing is assumed: a forecast
without a side, a line without quotes, no quote yet, or an unusable one is refused and says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY, fair
from .joins import asof

#: The line of forecasts that name none, and the edge that makes a recommendation.
LINE, EDGE = 9.5, 0.02


def entries(forecasts: DataFrame, quotes: DataFrame, as_of: int, line: float = LINE, edge: float = EDGE) -> DataFrame:
    """A row a forecast: id, match_id, kick_off, line, refused, direction, probability, market, odds, taken_at, edge, recommended, closing_odds, closing, closing_value, settled, won, units.

    forecasts: id, match_id, captured, kick_off (microseconds), probability (of over, on `line`; null), actual (null: not
    settled), pick: null or (line, direction, probability, market, odds, edge, recommended), which stands as it was made.
    quotes: match_id, line, captured, in_play, over_odds, under_odds. refused says why a forecast has no entry. The close is the last quote
    before kick-off, known once that has passed.
    """
    f = forecasts.withColumn("__line", F.coalesce("pick.line", F.lit(line))).withColumn("__k", F.round(F.col("__line") * 100).cast("long"))
    q = quotes.where(~F.coalesce("in_play", F.lit(False))).select("match_id", F.round(F.col("line") * 100).cast("long").alias("__k"), F.col("captured").alias("__at"), "over_odds", "under_odds")
    known = quotes.select("match_id", F.round(F.col("line") * 100).cast("long").alias("__k")).distinct().withColumn("__known", F.lit(True))
    priced = lambda prefix: {f"__{prefix}_over": F.col("over_odds"), f"__{prefix}_under": F.col("under_odds"), f"__{prefix}_at": F.col("__at")}
    f = asof(f, q, ["match_id", "__k"], F.col("captured"), F.col("__at"), priced("taken"))
    f = asof(f, q, ["match_id", "__k"], F.col("kick_off"), F.col("__at"), priced("close"), strict=True)
    f = f.join(known, ["match_id", "__k"], "left")
    picked, p = F.col("pick").isNotNull(), F.col("probability")
    over, under = F.col("__taken_over"), F.col("__taken_under")
    refused = F.when(picked, None).when(p.isNull(), "no side").when(F.col("__known").isNull(), "no timeline").when(F.col("__taken_at").isNull(), "no quote").when(~F.coalesce((over > 1) & (under > 1), F.lit(False)), "unusable odds")
    up, down = p * over - 1, (1 - p) * under - 1
    high = F.when(picked, F.col("pick.direction") == "high").otherwise(up >= down)
    side = lambda a, b: F.when(high, a).otherwise(b)
    mine = lambda c, other: F.when(picked, F.col(f"pick.{c}")).otherwise(other)
    gain = mine("edge", F.greatest(up, down))
    closed = (F.lit(as_of) > F.col("kick_off")) & (F.col("__close_over") > 1) & (F.col("__close_under") > 1)
    odds = mine("odds", side(over, under))
    f = f.withColumns({
        "refused": refused, "direction": side(F.lit("high"), F.lit("low")), "__p": mine("probability", side(p, 1 - p)), "market": mine("market", side(fair(over, under)[0], fair(under, over)[0])), "odds": odds, "taken_at": F.when(picked, F.col("captured")).otherwise(F.col("__taken_at")),
        "edge": gain, "recommended": F.coalesce(F.when(picked, F.col("pick.recommended") & (gain >= edge)).otherwise(gain >= edge), F.lit(False)),
        "closing_odds": F.when(closed, side(F.col("__close_over"), F.col("__close_under"))), "closing": F.when(closed, side(fair(F.col("__close_over"), F.col("__close_under"))[0], fair(F.col("__close_under"), F.col("__close_over"))[0])),
    })
    above = F.col("actual") > F.col("__line")
    f = f.withColumns({"settled": F.col("actual").isNotNull(), "won": side(above, ~above), "closing_value": F.col("odds") / F.col("closing_odds") - 1})
    f = f.withColumn("units", F.when(F.col("won"), F.col("odds") - 1).when(~F.col("won"), -1.0))
    told = ["direction", "__p", "market", "odds", "taken_at", "edge", "recommended", "closing_odds", "closing", "closing_value", "settled", "won", "units"]
    kept = [(F.when(F.col("refused").isNull(), F.col(c)) if c not in ("recommended", "settled") else (F.col(c) & F.col("refused").isNull())).alias("probability" if c == "__p" else c) for c in told]
    return f.select("id", "match_id", "kick_off", F.col("__line").alias("line"), "refused", *kept)


def drawdown(rows: DataFrame, order: list[str], day: str, gain: str) -> DataFrame:
    """One row: net, drawdown: the sum of the gains and the deepest fall from a peak (0 at first), in order.

    Each day is summed up by itself: its sum, the highest and lowest point that it reaches and its own deepest fall; then
    the days in turn. No window holds more than a day's rows, or a row a day.
    """
    w = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    walk = rows.select(day, *[c for c in order if c != day], gain).withColumn("__x", F.sum(gain).over(w))
    walk = walk.withColumn("__top", F.greatest(F.lit(0.0), F.max("__x").over(w)))
    days = walk.groupBy(day).agg(F.sum(gain).alias("t"), F.greatest(F.lit(0.0), F.max("__x")).alias("high"), F.least(F.lit(0.0), F.min("__x")).alias("low"), F.max(F.col("__top") - F.col("__x")).alias("fall"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("at", F.coalesce(F.sum("t").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("at") + F.col("high")).over(before), F.lit(0.0))))
    return days.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("net"), F.coalesce(F.max(F.greatest(F.col("fall"), F.col("peak") - F.col("at") - F.col("low"))), F.lit(0.0)).alias("drawdown"))


def summary(record: DataFrame) -> DataFrame:
    """One row over the recommended entries: recommended, settled, hits, brier, market_brier, samples, closing_value, beat_closing, closing_samples, net, drawdown.

    Each rate is over the entries that carry what it needs; 0 without any. The fall is in order of kick-off.
    """
    r = record.where("recommended")
    won = F.col("won").cast("double")
    scored = F.col("won").isNotNull() & F.col("probability").isNotNull() & F.col("market").isNotNull()
    error = lambda c: F.coalesce(F.avg(F.when(scored, (F.col(c) - won) * (F.col(c) - won))), F.lit(0.0))
    sums = r.agg(
        F.count("*").alias("recommended"), F.count(F.when(F.col("settled"), 1)).alias("settled"), F.count(F.when(F.col("won"), 1)).alias("hits"), error("probability").alias("brier"), error("market").alias("market_brier"), F.count(F.when(scored, 1)).alias("samples"),
        F.coalesce(F.avg("closing_value"), F.lit(0.0)).alias("closing_value"), F.coalesce(F.avg((F.col("closing_value") > 0).cast("double")), F.lit(0.0)).alias("beat_closing"), F.count("closing_value").alias("closing_samples"),
    )
    settled = r.where("settled").withColumn("__day", F.floor(F.col("kick_off") / DAY))
    return sums.join(F.broadcast(drawdown(settled, ["kick_off", "id"], "__day", "units")))  # a row each
