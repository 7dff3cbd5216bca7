"""Lines of fixtures, assessed and picked from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import track_record as T
from ..registry import query
from .joins import O, Q, orders, quotes

#: Orders as fixtures with three lines each: a half, a quarter and a whole one.
X = f"""{O}, f AS (SELECT id, 6 + id % 90 / 10.0::DOUBLE AS market_mean, 8 + id % 7::DOUBLE AS prior_mean, 0.01 + id % 5 * 0.02::DOUBLE AS prior_variance, id % 3 > 0 AS reliable, id % 4 * 0.02::DOUBLE AS dispersion, CASE WHEN id % 6 = 0 THEN 1.0 ELSE 0.3 + id % 6 / 10.0 END::DOUBLE AS trust,
  id % 8 = 0 AS adopted, id % 10 = 0 AS suspended, id % 9 = 0 AS drifting, id % 2 = 0 AS audited FROM o),
m AS (SELECT *, CASE WHEN reliable THEN exp((1 - w) * ln(market_mean) + w * ln(prior_mean)) ELSE market_mean END AS mean FROM (SELECT *, CASE WHEN reliable THEN 1 / prior_variance / (1 / prior_variance + 1 / 0.006) ELSE 0 END AS w FROM f)),
l AS (SELECT m.*, k AS place, floor(market_mean) - 0.5 + k * 0.75 AS line, CASE WHEN (id + k) % 5 = 0 THEN 'SUSPENDED' ELSE 'AVAILABLE' END AS status, CASE WHEN (id + k) % 13 > 0 THEN 1.2 + (id + 3 * k) % 17 / 10.0::DOUBLE END AS high_odds, 1.2 + (id * 2 + k) % 15 / 10.0::DOUBLE AS low_odds FROM m CROSS JOIN range(0, 3) t(k)),
c AS (SELECT *, unnest(CASE WHEN place = 1 THEN [line - 0.25, line + 0.25] ELSE [line] END) AS part FROM l WHERE high_odds > 1 AND low_odds > 1),
d AS (SELECT *, list_transform(range(0, floor(part)::BIGINT + 1), lambda n: CASE WHEN dispersion > 1e-9 THEN exp(lgamma(n + 1 / dispersion) - lgamma(1 / dispersion) - lgamma(n + 1) + 1 / dispersion * ln(1 / dispersion / (1 / dispersion + mean)) + n * ln(mean / (1 / dispersion + mean))) ELSE exp(-mean + n * ln(mean) - lgamma(n + 1)) END) AS pmf FROM c),
h AS (SELECT * EXCLUDE (part, pmf), CASE WHEN part = floor(part) THEN pmf[-1] ELSE 0 END AS push, list_sum(pmf) - CASE WHEN part = floor(part) THEN pmf[-1] ELSE 0 END AS loss FROM d),
a AS (SELECT id, place, any_value(line) AS line, any_value(status) AS status, any_value(high_odds) AS high_odds, any_value(low_odds) AS low_odds, any_value(mean) AS mean, any_value(trust) AS trust, any_value(adopted) AS adopted, avg(push) AS push, avg(loss) AS loss, 1 - avg(push) - avg(loss) AS win FROM h GROUP BY id, place),
p AS (SELECT *, win + push / 2 AS raw, 1 / high_odds / (1 / high_odds + 1 / low_odds) AS fair_high, 1 / high_odds + 1 / low_odds - 1 AS overround FROM a),
t AS (SELECT *, CASE WHEN adopted THEN 1 / (1 + exp(-(ln(fair_high / (1 - fair_high)) + 0.1 + 0.4 * greatest(-2, least(2, ln(greatest(1e-6, least(1 - 1e-6, raw)) / (1 - greatest(1e-6, least(1 - 1e-6, raw)))) - ln(fair_high / (1 - fair_high))))))) WHEN trust >= 1 THEN raw ELSE fair_high + trust * (raw - fair_high) END AS target FROM p),
s AS (SELECT *, greatest(0, least(1, (target - push / 2) / (win + loss))) AS share FROM t),
e AS (SELECT *, share * (win + loss) AS w, (1 - share) * (win + loss) AS x FROM s),
r AS (SELECT *, w + push / 2 AS high, w * (high_odds - 1) - x AS high_edge, x * (low_odds - 1) - w AS low_edge FROM e)"""


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    f = orders(spark, sf).select(
        "id", (6 + i % 90 / 10.0).alias("market_mean"), (8 + i % 7).cast("double").alias("prior_mean"), (0.01 + i % 5 * 0.02).alias("prior_variance"), (i % 3 > 0).alias("reliable"), (i % 4 * 0.02).alias("dispersion"),
        F.when(i % 6 == 0, 1.0).otherwise(0.3 + i % 6 / 10.0).alias("trust"), F.lit(0.1).alias("residual_bias"), F.lit(0.4).alias("residual_weight"), (i % 8 == 0).alias("adopted"), (i % 10 == 0).alias("suspended"), (i % 9 == 0).alias("drifting"), (i % 2 == 0).alias("audited"),
    )
    line = lambda k: F.struct((F.floor("market_mean") - 0.5 + k * 0.75).alias("line"), F.when((i + k) % 5 == 0, "SUSPENDED").otherwise("AVAILABLE").alias("status"), F.when((i + k) % 13 > 0, 1.2 + (i + 3 * k) % 17 / 10.0).alias("high_odds"), (1.2 + (i * 2 + k) % 15 / 10.0).alias("low_odds"))
    return f.withColumn("lines", F.array(*[line(k) for k in range(3)]))


@query(f"WITH {X} SELECT id, place::INT AS place, line, status, round(fair_high, 6) AS fair_high, round(raw, 6) AS raw, round(high, 6) AS high, round(push, 6) AS push, round(high_edge, 6) AS high_edge, round(low_edge, 6) AS low_edge, round(mean, 6) AS mean FROM r")
def q_assessed_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = L.assessed(fixtures(spark, sf))
    return a.select("id", "place", "line", "status", *[F.round(c, 6).alias(c) for c in ("fair_high", "raw", "high", "push", "high_edge", "low_edge", "mean")])


@query(f"""
WITH {X}, z AS (SELECT id, place, line, 1 AS is_high, high_odds AS odds, high_edge AS edge, high AS p, push FROM r WHERE status = 'AVAILABLE' UNION ALL SELECT id, place, line, 0, low_odds, low_edge, 1 - high, push FROM r WHERE status = 'AVAILABLE'),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY edge DESC, place, is_high DESC) = 1),
g AS (SELECT id, count(*) AS lines, sqrt(avg((high - fair_high) ** 2)) AS gap, avg(overround) AS overround FROM r GROUP BY 1),
j AS (SELECT *, NOT suspended AND edge > 0 AND edge >= 0.02 AS taken, 0.40 * greatest(0, least(1, edge / 0.10)) + 0.22 * greatest(0, least(1, 1 - gap / 0.05)) + 0.13 * greatest(0, least(1, (lines - 1) / 3.0::DOUBLE)) + 0.13 * greatest(0, least(1, 1 - overround / 0.10))
    + 0.12 * (reliable AND CASE WHEN is_high = 1 THEN prior_mean - market_mean > 0.15 ELSE prior_mean - market_mean < -0.15 END)::INT AS c FROM g JOIN m USING (id) LEFT JOIN b USING (id))
SELECT id, lines, round(gap, 6) AS gap, CASE WHEN edge IS NULL THEN NULL WHEN taken THEN 'pick' ELSE 'watch' END AS kind, line, CASE is_high WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS direction, round(odds, 6) AS odds, round(edge, 6) AS edge, round(p, 6) AS probability,
  CASE WHEN edge IS NOT NULL THEN round(CASE WHEN drifting THEN least(c, 0.30) WHEN audited THEN c ELSE least(c, 0.39) END, 6) END AS confidence, CASE WHEN edge IS NOT NULL AND NOT taken THEN round(greatest(0, least(1, (1.02 - push * (1 - odds / 2)) / odds)), 6) END AS required FROM j
""")
def q_line_picks(spark: SparkSession, sf: str) -> DataFrame:
    """The side worth taking of every fixture, or the one to watch, with how sure that is."""
    p = L.picks(fixtures(spark, sf))
    return p.select("id", "lines", "kind", "line", "direction", *[F.round(c, 6).alias(c) for c in ("gap", "odds", "edge", "probability", "confidence", "required")])


@query(f"WITH {Q} SELECT id, kind, key, row_number() OVER (PARTITION BY key ORDER BY (kind = 'view')::INT DESC, price DESC, ts_us DESC, id DESC) AS place FROM q WHERE kind LIKE 'v%' OR kind LIKE 'c%'")
def q_open_first(spark: SparkSession, sf: str) -> DataFrame:
    """Views as open trades, clicks as settled ones: the open ones of a key first."""
    q = quotes(spark, sf).where("kind like 'v%' or kind like 'c%'").withColumns({"settled": F.when(F.col("kind") != "view", F.col("ts_us")), "created": F.struct("ts_us", "id")})
    return L.open_first(q, ["key"], "settled", "price", "created").select("id", "kind", "key", F.col("place").cast("long").alias("place"))


AS_OF = 1_720_000_000_000_000

#: Purchases as forecasts, a third of them picks on a line of their own, and views and clicks as quotes on two lines.
RECORD = f"""{Q}, fc AS (SELECT id, key AS match_id, ts_us AS captured, ts_us + id % 40 * 3600000000 AS kick_off, CASE WHEN id % 11 > 0 THEN (20 + id % 61) / 100.0::DOUBLE END AS probability, CASE WHEN id % 7 > 0 THEN id % 20 END AS actual, id % 3 = 0 AS picked FROM q WHERE kind = 'purchase'),
qt AS (SELECT key AS match_id, CASE WHEN id % 2 = 0 THEN 9.5 ELSE 10.5 END AS line, ts_us AS captured, 0.9 + id % 23 / 10.0::DOUBLE AS o, 1.3 + id % 17 / 10.0::DOUBLE AS u FROM q WHERE kind = 'view'),
f AS (SELECT *, CASE WHEN picked THEN 10.5 ELSE 9.5 END AS line FROM fc), a AS (SELECT f.*, t.o AS ao, t.u AS au, t.captured AS at_ FROM f ASOF LEFT JOIN qt t ON f.match_id = t.match_id AND f.line = t.line AND f.captured >= t.captured),
b AS (SELECT a.*, t.o AS co, t.u AS cu FROM a ASOF LEFT JOIN qt t ON a.match_id = t.match_id AND a.line = t.line AND a.kick_off > t.captured), n AS (SELECT DISTINCT match_id, line, true AS known FROM qt),
r AS (SELECT b.*, CASE WHEN picked THEN NULL WHEN probability IS NULL THEN 'no side' WHEN known IS NULL THEN 'no timeline' WHEN at_ IS NULL THEN 'no quote' WHEN NOT (ao > 1 AND au > 1) THEN 'unusable odds' END AS refused, CASE WHEN picked THEN id % 2 = 0 ELSE probability * ao - 1 >= (1 - probability) * au - 1 END AS high FROM b LEFT JOIN n USING (match_id, line)),
e AS (SELECT id, kick_off, line, refused, high, CASE WHEN picked THEN 0.5 WHEN high THEN probability ELSE 1 - probability END AS p, CASE WHEN picked THEN 0.45 WHEN high THEN 1 / ao / (1 / ao + 1 / au) ELSE 1 / au / (1 / ao + 1 / au) END AS market, CASE WHEN picked THEN 2.1 WHEN high THEN ao ELSE au END AS odds,
    CASE WHEN picked THEN (id % 9 - 3) / 50.0::DOUBLE ELSE greatest(probability * ao - 1, (1 - probability) * au - 1) END AS edge, picked, CASE WHEN {AS_OF} > kick_off AND co > 1 AND cu > 1 THEN CASE WHEN high THEN co ELSE cu END END AS closing_odds, actual, CASE WHEN high THEN actual > line ELSE NOT actual > line END AS won FROM r),
g AS (SELECT *, coalesce(CASE WHEN picked THEN id % 5 > 0 AND edge >= 0.02 ELSE edge >= 0.02 END, false) AND refused IS NULL AS recommended, odds / closing_odds - 1 AS value, CASE WHEN won THEN odds - 1 WHEN NOT won THEN -1 END AS units FROM e)"""


def record(spark: SparkSession, sf: str) -> DataFrame:
    q, i = quotes(spark, sf), F.col("id")
    pick = F.struct(F.lit(10.5).alias("line"), F.when(i % 2 == 0, "high").otherwise("low").alias("direction"), F.lit(0.5).alias("probability"), F.lit(0.45).alias("market"), F.lit(2.1).alias("odds"), ((i % 9 - 3) / 50.0).alias("edge"), (i % 5 > 0).alias("recommended"))
    f = q.where("kind = 'purchase'").select("id", F.col("key").alias("match_id"), F.col("ts_us").alias("captured"), (F.col("ts_us") + i % 40 * 3_600_000_000).alias("kick_off"), F.when(i % 11 > 0, (20 + i % 61) / 100.0).alias("probability"), F.when(i % 7 > 0, i % 20).alias("actual"), F.when(i % 3 == 0, pick).alias("pick"))
    t = q.where("kind = 'view'").select(F.col("key").alias("match_id"), F.when(i % 2 == 0, 9.5).otherwise(10.5).alias("line"), F.col("ts_us").alias("captured"), F.lit(False).alias("in_play"), (0.9 + i % 23 / 10.0).alias("over_odds"), (1.3 + i % 17 / 10.0).alias("under_odds"))
    return T.entries(f, t, AS_OF)


@query(f"""
WITH {RECORD} SELECT id, refused, CASE WHEN refused IS NULL THEN CASE WHEN high THEN 'high' ELSE 'low' END END AS direction, CASE WHEN refused IS NULL THEN round(p, 6) END AS probability, CASE WHEN refused IS NULL THEN round(market, 6) END AS market, CASE WHEN refused IS NULL THEN round(odds, 6) END AS odds,
  CASE WHEN refused IS NULL THEN round(edge, 6) END AS edge, recommended, CASE WHEN refused IS NULL THEN round(value, 6) END AS closing_value, CASE WHEN refused IS NULL THEN won END AS won, CASE WHEN refused IS NULL THEN round(units, 6) END AS units FROM g
""")
def q_track_record(spark: SparkSession, sf: str) -> DataFrame:
    """Every forecast with the quote that stood when it was made, its close and its outcome, or why it has none."""
    return record(spark, sf).select("id", "refused", "direction", "recommended", "won", *[F.round(c, 6).alias(c) for c in ("probability", "market", "odds", "edge", "closing_value", "units")])


@query(f"""
WITH {RECORD}, w AS (SELECT * FROM g WHERE recommended), c AS (SELECT *, sum(units) OVER (ORDER BY kick_off, id) AS x FROM w WHERE actual IS NOT NULL), d AS (SELECT *, greatest(0, max(x) OVER (ORDER BY kick_off, id)) - x AS fall FROM c)
SELECT count(*) AS recommended, count(actual) AS settled, count(*) FILTER (WHERE won) AS hits, round(avg((p - won::INT) ** 2), 6) AS brier, round(avg((market - won::INT) ** 2), 6) AS market_brier, round(coalesce(avg(value), 0), 6) AS closing_value, round(coalesce(avg((value > 0)::INT), 0), 6) AS beat_closing,
  count(value) AS closing_samples, round((SELECT sum(units) FROM c), 6) AS net, round((SELECT max(fall) FROM d), 6) AS drawdown FROM w
""")
def q_record_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = T.summary(record(spark, sf))
    return s.select("recommended", "settled", "hits", "closing_samples", *[F.round(c, 6).alias(c) for c in ("brier", "market_brier", "closing_value", "beat_closing", "net", "drawdown")])
