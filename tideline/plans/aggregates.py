"""Aggregates: forecast scores, returns, dispersion, drift, number statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY
from ..operators import aggregates as A
from ..operators import joins as J
from ..registry import query, table
from .joins import O, Q, orders, quotes
from .scalars import DRAW_SQL, draws

P_SQL = f"WITH {Q}, p AS (SELECT id, key, kind, ts_us, price, (1 + id % 97) / 99.0::DOUBLE AS p, (kind = 'view')::INT AS y FROM q)"


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return quotes(spark, sf).withColumns({"p": (1 + F.col("id") % 97) / 99.0, "y": (F.col("kind") == "view").cast("int")})


@query(f"{P_SQL} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM p GROUP BY 1")
def q_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return A.reliability(forecasts(spark, sf), F.col("p"), F.col("y")).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


@query(f"""{P_SQL}, b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS e, avg(y) AS o FROM p GROUP BY 1)
SELECT round(sum(abs(e - o) * n) / sum(n), 6) AS expected, round(max(abs(e - o)), 6) AS maximum FROM b""")
def q_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return A.calibration_error(A.reliability(forecasts(spark, sf), F.col("p"), F.col("y"))).select(F.round("expected", 6).alias("expected"), F.round("maximum", 6).alias("maximum"))


@query(f"""{P_SQL} SELECT kind, round(avg(power(p - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss,
  round(1 - avg(power(p - y, 2)) / avg(power(0.2 - y, 2)), 6) AS skill FROM p GROUP BY 1""")
def q_forecast_scores(spark: SparkSession, sf: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return forecasts(spark, sf).groupBy("kind").agg(F.round(A.brier(p, y), 6).alias("brier"), F.round(A.log_loss(p, y), 6).alias("log_loss"), F.round(1 - A.brier(p, y) / A.brier(F.lit(0.2), y), 6).alias("skill"))


@query(f"""WITH {O}, f AS (SELECT price / 1000 AS y, 100 + key % 300 AS mu FROM o)
SELECT round(avg(abs(y - mu)), 6) AS mae, round(avg((abs(y - mu) <= 20)::INT), 6) AS within, round(avg((y BETWEEN mu - 60 AND mu + 60)::INT), 6) AS coverage,
  round(greatest(0.02, (avg(power(y - mu, 2)) - avg(mu)) / power(avg(mu), 2)), 6) AS pooled, round(greatest(0, avg((power(y - mu, 2) - mu) / power(mu, 2))), 6) AS mean_ratio,
  round(quantile_cont(y - mu, 0.1), 6) AS q10, round(quantile_cont(y - mu, 0.9), 6) AS q90 FROM f""")
def q_residuals(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf).select((F.col("price") / 1000).alias("y"), (100 + F.col("key") % 300).alias("mu"))
    e, mu = F.col("y") - F.col("mu"), F.col("mu")
    return f.agg(
        F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg((F.abs(e) <= 20).cast("int")), 6).alias("within"), F.round(F.avg(F.col("y").between(mu - 60, mu + 60).cast("int")), 6).alias("coverage"),
        F.round(F.greatest(F.lit(0.02), (F.avg(e * e) - F.avg(mu)) / F.pow(F.avg(mu), 2)), 6).alias("pooled"), F.round(F.greatest(F.lit(0.0), F.avg((e * e - mu) / (mu * mu))), 6).alias("mean_ratio"),
        *[F.round(F.lit(J.quantile(f.select(e.alias("e")), "e", q)), 6).alias(f"q{int(q * 100)}") for q in (0.1, 0.9)],
    )


@query(f"""{P_SQL} SELECT kind, key % 5 AS sport, count(*) AS n, round(sum(CASE WHEN y = 1 THEN price / 50 ELSE -1 END) / count(*), 6) AS roi FROM p GROUP BY GROUPING SETS ((kind), (key % 5), ())""")
def q_returns(spark: SparkSession, sf: str) -> DataFrame:
    f = forecasts(spark, sf).withColumn("sport", F.col("key") % 5)
    gain = F.when(F.col("y") == 1, F.col("price") / 50).otherwise(-1.0)
    return f.groupingSets([[F.col("kind")], [F.col("sport")], []], "kind", "sport").agg(F.count("*").alias("n"), F.round(F.sum(gain) / F.count("*"), 6).alias("roi")).select("kind", "sport", "n", "roi")


@query(f"""{P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, id DESC) AS n FROM p)
SELECT key, count(*) FILTER (WHERE n <= 15) AS recent, count(*) FILTER (WHERE n BETWEEN 16 AND 30) AS earlier,
  CASE WHEN count(*) FILTER (WHERE n BETWEEN 16 AND 30) < 15 THEN 'insufficient' WHEN avg(CASE WHEN n <= 15 THEN power(p - y, 2) END) > 1.35 * avg(CASE WHEN n BETWEEN 16 AND 30 THEN power(p - y, 2) END) THEN 'stop'
  WHEN avg(CASE WHEN n <= 15 THEN power(p - y, 2) END) > 1.15 * avg(CASE WHEN n BETWEEN 16 AND 30 THEN power(p - y, 2) END) THEN 'watch' ELSE 'healthy' END AS state FROM r WHERE n <= 30 GROUP BY 1""")
def q_drift_blocks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts_us"), F.desc("id")))
    r = forecasts(spark, sf).withColumn("n", n).where("n <= 30")
    new, old, e = F.col("n") <= 15, F.col("n") > 15, F.pow(F.col("p") - F.col("y"), 2)
    g = r.groupBy("key").agg(F.count(F.when(new, 1)).alias("recent"), F.count(F.when(old, 1)).alias("earlier"), F.avg(F.when(new, e)).alias("a"), F.avg(F.when(old, e)).alias("b"))
    state = F.when(F.col("earlier") < 15, "insufficient").when(F.col("a") > 1.35 * F.col("b"), "stop").when(F.col("a") > 1.15 * F.col("b"), "watch").otherwise("healthy")
    return g.select("key", "recent", "earlier", state.alias("state"))


@query(f"""WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), t AS (SELECT count(*) AS draws, sum(len(numbers)) AS balls, max(draw_id) AS last FROM d), x AS (SELECT draw_id, unnest(numbers) AS n FROM d),
f AS (SELECT n, count(*) AS times, max(draw_id) AS seen FROM x GROUP BY 1)
SELECT n, times, last - seen AS gap, round((times - balls / 49.0::DOUBLE) / sqrt(balls / 49.0::DOUBLE * (1 - 6 / 49.0::DOUBLE)), 6) AS z,
  round(power(times - balls / 49.0::DOUBLE, 2) / (balls / 49.0::DOUBLE), 6) AS chi FROM f CROSS JOIN t""")
def q_number_bias(spark: SparkSession, sf: str) -> DataFrame:
    d = draws(spark, sf)
    f = d.select("draw_id", F.explode("numbers").alias("n")).groupBy("n").agg(F.count("*").alias("times"), F.max("draw_id").alias("seen"))  # 49 rows
    every = Window.partitionBy()
    f = f.withColumns({"e": F.sum("times").over(every) / 49.0, "last": F.max("seen").over(every)})
    last = d.agg(F.max("draw_id").alias("newest"))
    f = f.join(F.broadcast(last))
    e = F.col("e")
    return f.select("n", "times", (F.col("newest") - F.col("seen")).alias("gap"), F.round((F.col("times") - e) / F.sqrt(e * (1 - 6 / 49.0)), 6).alias("z"), F.round(F.pow(F.col("times") - e, 2) / e, 6).alias("chi"))


@query(f"""WITH {Q}, n AS (SELECT kind, count(*) AS n, sum(count(*)) OVER () AS t FROM q GROUP BY 1)
SELECT round(sum(-(n / t::DOUBLE) * ln(n / t::DOUBLE)) / ln(count(*)), 6) AS entropy, count(*) AS kinds, round(sum(-(n / t::DOUBLE) * ln(n / t::DOUBLE)) / ln(2) + (count(*) - 1) / (2 * max(t)::DOUBLE * ln(2)), 6) AS bits FROM n""")
def q_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return A.entropy(quotes(spark, sf), "kind").select(F.round("entropy", 6).alias("entropy"), "kinds", F.round("bits", 6).alias("bits"))


@query("""SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(avg(c_acctbal), 7) AS mean, round(var_samp(c_acctbal), 2) AS variance, round(stddev_pop(c_acctbal), 4) AS spread,
  round(covar_samp(c_acctbal, c_nationkey), 3) AS covariance, round(corr(c_acctbal, c_nationkey), 6) AS r FROM customer GROUP BY 1""")
def q_moments(spark: SparkSession, sf: str) -> DataFrame:
    b, n = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg(b), 7).alias("mean"), F.round(F.var_samp(b), 2).alias("variance"),
        F.round(F.stddev_pop(b), 4).alias("spread"), F.round(F.covar_samp(b, n), 3).alias("covariance"), F.round(F.corr(b, n), 6).alias("r"),
    )


@query(f"""WITH {Q}, g AS (SELECT key, kind, ts_us // {DAY} AS day, count(*) AS n, sum(price) AS won, sum((1 + id % 97) / 99.0::DOUBLE) AS expected FROM q GROUP BY 1, 2, 3)
SELECT kind, count(*) AS cells, round(sum(won) / sum(expected), 4) AS ratio, round(sum(n * expected) / sum(n), 5) AS weighted FROM g GROUP BY 1""")
def q_daily_ratio(spark: SparkSession, sf: str) -> DataFrame:
    g = quotes(spark, sf).groupBy("key", "kind", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.count("*").alias("n"), F.sum("price").alias("won"), F.sum((1 + F.col("id") % 97) / 99.0).alias("expected"))
    return g.groupBy("kind").agg(F.count("*").alias("cells"), F.round(F.sum("won") / F.sum("expected"), 4).alias("ratio"), F.round(F.sum(F.col("n") * F.col("expected")) / F.sum("n"), 5).alias("weighted"))


@query("""WITH r AS (SELECT l_orderkey AS race, sum(1 / (1 + l_quantity)) AS book, count(*) AS n, max(l_discount) AS most FROM lineitem GROUP BY 1)
SELECT race, n, round(book, 6) AS book, array_to_string(list_filter([CASE WHEN n < 2 THEN 'too few' END, CASE WHEN book > 1 THEN 'over full' END, CASE WHEN most > 0.09 THEN 'odd price' END], lambda x: x IS NOT NULL), ',') AS violations FROM r""")
def q_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A book of exactly 1 is full, not over full, in whatever order its shares are added up."""
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("race")).agg(F.sum(1 / (1 + F.col("l_quantity"))).alias("book"), F.count("*").alias("n"), F.max("l_discount").alias("most"))
    found = F.array_compact(F.array(F.when(F.col("n") < 2, "too few"), F.when(F.round("book", 12) > 1, "over full"), F.when(F.col("most") > 0.09, "odd price")))
    return r.select("race", "n", F.round("book", 6).alias("book"), F.array_join(found, ",").alias("violations"))


@query(f"""WITH {O}, y AS (SELECT key, CASE WHEN month >= 8 THEN y ELSE y - 1 END AS season, price FROM (SELECT o_custkey AS key, year(o_orderdate) AS y, month(o_orderdate) AS month, o_totalprice AS price FROM orders))
SELECT season, count(*) AS n, count(DISTINCT key) AS keys, round(sum(price), 2) AS total FROM y GROUP BY 1""")
def q_season_counts(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.month("o_orderdate") >= 8, F.year("o_orderdate")).otherwise(F.year("o_orderdate") - 1).cast("long")
    return table(spark, sf, "orders").groupBy(first.alias("season")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))
