"""Policies over priced selections, and market means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import bootstrap
from ..operators import policy as P
from ..operators.bootstrap import uniform_sql, weight_sql
from ..registry import query
from .joins import O, orders

B = f"{O}, b AS (SELECT id, day, 1.2 + id % 31 / 10.0::DOUBLE AS over_odds, 1.3 + id % 17 / 8.0::DOUBLE AS under_odds, (10 + id % 83) / 100.0::DOUBLE AS p, price > 150000 AS over_won FROM o), v AS (SELECT *, p * over_odds - 1 AS ov, (1 - p) * under_odds - 1 AS uv FROM b)"
S = f"{B}, s AS (SELECT id, day, CASE WHEN ov >= uv THEN 'over' ELSE 'under' END AS direction, greatest(ov, uv) AS value, CASE WHEN ov >= uv THEN over_odds ELSE under_odds END AS odds, CASE WHEN ov >= uv THEN over_won ELSE NOT over_won END AS won FROM v)"


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a priced two-way market, with its better side."""
    i = F.col("id")
    b = orders(spark, sf).select("id", "day", (1.2 + i % 31 / 10.0).alias("over_odds"), (1.3 + i % 17 / 8.0).alias("under_odds"), ((10 + i % 83) / 100.0).alias("p"), (F.col("price") > 150000).alias("over_won"))
    return P.sided(b.withColumns({"over_value": F.col("p") * F.col("over_odds") - 1, "under_value": (1 - F.col("p")) * F.col("under_odds") - 1}))


@query(f"WITH {S} SELECT id, direction, round(value, 6) AS value, round(odds, 6) AS odds, won FROM s WHERE value >= 0.05 AND odds > 1 AND odds <= 3")
def q_policy_selections(spark: SparkSession, sf: str) -> DataFrame:
    return selections(spark, sf).where(P.taken(3.0, 0.05)).select("id", "direction", F.round("value", 6).alias("value"), F.round("odds", 6).alias("odds"), "won")


@query(f"""
WITH {S}, g AS (SELECT * FROM (SELECT unnest([3.0::DOUBLE, 5.0, 10.0]) AS maximum_odds) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.02, 0.05, 0.08, 0.1, 0.15]) AS minimum_value))
SELECT maximum_odds, minimum_value, count(*) AS bets, round(avg(CASE WHEN won THEN odds - 1 ELSE -1 END), 6) AS roi, count(DISTINCT day) AS days FROM g JOIN s ON value >= minimum_value AND odds > 1 AND odds <= maximum_odds GROUP BY 1, 2
""")
def q_policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    days = P.grid_days(selections(spark, sf))
    return days.groupBy("maximum_odds", "minimum_value").agg(F.sum("bets").alias("bets"), F.round(F.sum("net") / F.sum("bets"), 6).alias("roi"), F.count("*").alias("days"))


@query(f"""
WITH {S}, g AS (SELECT * FROM (SELECT unnest([3.0::DOUBLE, 5.0, 10.0]) AS maximum_odds) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.02, 0.05, 0.08, 0.1, 0.15]) AS minimum_value)),
t AS (SELECT maximum_odds, minimum_value, day, sum(CASE WHEN won THEN odds - 1 ELSE -1 END) AS net, count(*) AS bets FROM g JOIN s ON value >= minimum_value AND odds > 1 AND odds <= maximum_odds GROUP BY 1, 2, 3),
u AS MATERIALIZED (SELECT day, draw, {uniform_sql("day", "draw", 202607)} AS u FROM (SELECT DISTINCT day FROM s) CROSS JOIN range(1, 1001) r(draw)), w AS (SELECT day, draw, {weight_sql("u")} AS w FROM u),
x AS (SELECT maximum_odds, minimum_value, draw, sum(w * net) / sum(w * bets) AS roi FROM t JOIN w USING (day) WHERE w > 0 GROUP BY 1, 2, 3),
l AS (SELECT maximum_odds, minimum_value, quantile_cont(roi, 0.1) AS lower FROM x GROUP BY 1, 2),
p AS (SELECT maximum_odds, minimum_value, sum(bets)::BIGINT AS bets, sum(net) / sum(bets) AS roi FROM t GROUP BY 1, 2)
SELECT maximum_odds, minimum_value, bets, round(roi, 6) AS roi, round(lower, 6) AS lower, lower > 0 AS enabled, CASE WHEN lower > 0 THEN 'passed' ELSE 'lower return not positive' END AS reason
FROM p JOIN l USING (maximum_odds, minimum_value) WHERE bets >= 100 ORDER BY lower DESC, maximum_odds, minimum_value LIMIT 1
""")
def q_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The policy that a thousand bootstraps of the days favour: one row."""
    out = P.chosen(P.drawn_returns(selections(spark, sf)))
    return out.withColumns({"roi": F.round("roi", 6), "lower": F.round("lower", 6)})


@query(f"""
WITH {S}, dd AS (SELECT day, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS days FROM (SELECT DISTINCT day FROM s)), cut AS (SELECT *, greatest(1, floor(days * 0.7 + 1e-9)) AS a FROM dd),
pt AS (SELECT day, CASE WHEN n <= a THEN 'development' WHEN n <= greatest(a + 1, floor(days * 0.85 + 1e-9)) THEN 'validation' ELSE 'locked' END AS part FROM cut), h AS (SELECT s.*, part FROM s JOIN pt USING (day)),
g AS (SELECT * FROM (SELECT unnest([3.0::DOUBLE, 5.0, 10.0]) AS maximum_odds) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.02, 0.05, 0.08, 0.1, 0.15]) AS minimum_value)),
t AS (SELECT maximum_odds, minimum_value, day, sum(CASE WHEN won THEN odds - 1 ELSE -1 END) AS net, count(*) AS bets FROM g JOIN h ON value >= minimum_value AND odds > 1 AND odds <= maximum_odds AND part = 'validation' GROUP BY 1, 2, 3),
u AS MATERIALIZED (SELECT day, draw, {uniform_sql("day", "draw", 202607)} AS u FROM (SELECT day FROM pt WHERE part = 'validation') CROSS JOIN range(1, 1001) r(draw)), w AS (SELECT day, draw, {weight_sql("u")} AS w FROM u),
x AS (SELECT maximum_odds, minimum_value, draw, sum(w * net) / sum(w * bets) AS roi FROM t JOIN w USING (day) WHERE w > 0 GROUP BY 1, 2, 3), l AS (SELECT maximum_odds, minimum_value, quantile_cont(roi, 0.1) AS lower FROM x GROUP BY 1, 2),
p AS (SELECT maximum_odds, minimum_value, sum(bets)::BIGINT AS bets, sum(net) / sum(bets) AS roi FROM t GROUP BY 1, 2),
one AS (SELECT * FROM p JOIN l USING (maximum_odds, minimum_value) WHERE bets >= 30 ORDER BY lower DESC, maximum_odds, minimum_value LIMIT 1),
k AS (SELECT day, sum(CASE WHEN won THEN odds - 1 ELSE -1 END) AS net, count(*) AS bets FROM h, one WHERE part = 'locked' AND value >= minimum_value AND odds > 1 AND odds <= maximum_odds GROUP BY 1),
lv AS MATERIALIZED (SELECT k.*, draw, {uniform_sql("day", "draw", 202608)} AS u FROM k CROSS JOIN range(1, 1001) r(draw)), y AS (SELECT draw, sum(w * net) / sum(w * bets) AS roi FROM (SELECT *, {weight_sql("u")} AS w FROM lv) WHERE w > 0 GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM pt) AS days, (SELECT coalesce(sum(bets), 0)::BIGINT FROM k) AS locked_bets, (SELECT sum(net) / sum(bets) FROM k) AS locked_roi, (SELECT quantile_cont(roi, 0.1) FROM y) AS locked_lower),
q AS (SELECT *, CASE WHEN days < 20 THEN 'too few days' WHEN NOT lower > 0 THEN 'lower return not positive' WHEN locked_bets < 30 THEN 'too few locked bets' WHEN locked_lower <= 0 THEN 'locked lower return not positive' ELSE 'passed' END AS reason FROM one, z)
SELECT reason = 'passed' AS enabled, reason, maximum_odds, minimum_value, bets AS validation_bets, round(roi, 6) AS validation_roi, round(lower, 6) AS validation_lower, locked_bets, round(coalesce(locked_roi, 0), 6) AS locked_roi, round(coalesce(locked_lower, -1), 6) AS locked_lower FROM q
""")
def q_policy_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the policy chosen on the validation days holds on the locked ones: one row."""
    out = P.gate(selections(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("validation_roi", "validation_lower", "locked_roi", "locked_lower")})


@query(f"""
WITH {S}, t AS (SELECT day, id % 2 AS sport, sum(CASE WHEN won THEN odds - 1 ELSE -1 END * (1 + id % 3)) AS gain, sum(1 + id % 3) AS stake FROM s WHERE value >= 0.05 GROUP BY 1, 2),
u AS MATERIALIZED (SELECT draw, gain, stake, {uniform_sql("day || '-' || sport", "draw", 20260713)} AS u FROM t CROSS JOIN range(1, 2001) r(draw)), w AS (SELECT *, {weight_sql("u")} AS w FROM u),
d AS (SELECT draw, CASE WHEN sum(w * stake) <> 0 THEN sum(w * gain) / sum(w * stake) ELSE 0 END AS roi FROM w GROUP BY draw), l AS (SELECT list(roi ORDER BY roi) AS v FROM d)
SELECT (SELECT count(*) FROM t) AS blocks, round((SELECT sum(gain) / sum(stake) FROM t), 6) AS roi, round(v[101], 6) AS p50, round(v[1900], 6) AS p950, round(v[51], 6) AS p25, round(v[1950], 6) AS p975 FROM l
""")
def q_return_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The return of all bets worth taking with its 90 and 95 % intervals, over two thousand bootstraps of meetings: one row."""
    rows = selections(spark, sf).where("value >= 0.05").select("day", (F.col("id") % 2).alias("sport"), (1 + F.col("id") % 3).alias("stake"), F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0).alias("r"))
    out = bootstrap.intervals(rows, ["day", "sport"], F.col("r") * F.col("stake"), F.col("stake"))
    return out.select("blocks", *[F.round(c, 6).alias(c) for c in ("roi", "p50", "p950", "p25", "p975")])


@query("SELECT o_orderkey AS id, round(6 + o_orderkey % 90 / 10.0::DOUBLE, 4) AS mean FROM orders")
def q_implied_means(spark: SparkSession, sf: str) -> DataFrame:
    """Bisection over each row's lines; the mean that a row's prices were made from comes out again."""
    masses = E.poisson_masses(F.col("true"))
    lines = F.array(F.lit(8.5), F.lit(9.5), F.lit(10.5))
    rows = orders(spark, sf).select("id", (6 + F.col("id") % 90 / 10.0).alias("true")).select("id", "true", masses.alias("m"))
    rows = rows.select("id", "true", lines.alias("lines"), F.array(*[E.over_mass(F.col("m"), F.lit(x)) for x in (8.5, 9.5, 10.5)]).alias("shares"), F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("weights"))
    return P.implied_means(rows, "id").select("id", F.round("mean", 4).alias("mean"))
