"""Strictly earlier means, rates and gaps; group shares; opening and closing prices; drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY
from ..operators import joins as J
from ..operators import windows as W
from ..registry import query, table
from .joins import O, Q, orders, quotes


@query(f"""
WITH {O} SELECT id, round(avg(price) OVER (PARTITION BY key ORDER BY day, id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS with_own,
  round(avg(price) OVER (PARTITION BY key ORDER BY day, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS before FROM o
""")
def q_rolling_means(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).select("id", F.round(F.avg("price").over(W.recent(["key"], ["day", "id"], 6, current=True)), 4).alias("with_own"), F.round(F.avg("price").over(W.recent(["key"], ["day", "id"], 6)), 4).alias("before"))


@query(f"""
WITH {O} SELECT a.id, count(b.id) AS starts, count(b.id) FILTER (WHERE (b.price > 250000)) AS wins,
  round((count(b.id) FILTER (WHERE (b.price > 250000)) + 0.1 * 10) / (count(b.id) + 10.0::DOUBLE), 6) AS rate
FROM o a LEFT JOIN o b ON a.key = b.key AND b.day < a.day GROUP BY a.id
""")
def q_prior_rate(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    p = W.prior(o, ["key"], "day", {"starts": F.lit(1), "wins": (F.col("price") > 250000).cast("int")})
    return J.beside(o, p, ["key", "day"]).select("id", "starts", "wins", F.round(W.smoothed(F.col("wins"), F.col("starts"), 0.1, 10.0), 6).alias("rate"))


@query(f"""
WITH {O}, d AS (SELECT DISTINCT key, day FROM o), g AS (SELECT key, day, day - lag(day) OVER (PARTITION BY key ORDER BY day) AS gap FROM d)
SELECT id, gap, greatest(2, least(30, coalesce(gap, 7))) AS rest, round(ln(1 + coalesce(gap, 90)) / ln(181), 6) AS freshness FROM o JOIN g USING (key, day)
""")
def q_rest_days(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("key").orderBy("day"))
    g = o.select("key", "day").distinct().withColumn("gap", gap)
    return J.beside(o, g, ["key", "day"]).select("id", "gap", F.greatest(F.lit(2), F.least(F.lit(30), F.coalesce("gap", F.lit(7)))).alias("rest"), F.round(F.log(1 + F.coalesce("gap", F.lit(90))) / F.log(F.lit(181.0)), 6).alias("freshness"))


@query(f"""
WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, id) AS n FROM o)
SELECT a.id, round((coalesce(sum(b.price * power(0.5, (a.day - b.day) / 365.0::DOUBLE)), 0) + 200000 * 3) / (coalesce(sum(power(0.5, (a.day - b.day) / 365.0::DOUBLE)), 0) + 3), 4) AS mean
FROM r a LEFT JOIN r b ON a.key = b.key AND b.n < a.n AND b.n >= a.n - 30 GROUP BY a.id
""")
def q_decayed_mean(spark: SparkSession, sf: str) -> DataFrame:
    past = F.collect_list(F.struct("day", F.col("price").alias("value"))).over(W.recent(["key"], ["day", "id"], 30))
    return orders(spark, sf).withColumn("past", past).select("id", F.round(W.decayed_mean(F.col("past"), F.col("day"), 365.0, 200000.0, 3.0), 4).alias("mean"))


@query(f"""
WITH {O}, b AS (SELECT *, round(price / 50000)::INT AS band FROM o)
SELECT a.id, a.band, count(b.id) AS n, round((coalesce(sum(b.price), 0) + 5 * 200000) / (count(b.id) + 5), 6) AS mean FROM b a LEFT JOIN b ON a.key = b.key AND a.band = b.band AND b.day < a.day GROUP BY 1, 2
""")
def q_band_rate(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf).withColumn("band", F.round(F.col("price") / 50000).cast("int"))
    p = W.prior(o, ["key", "band"], "day", {"n": F.lit(1), "total": F.col("price")})
    return J.beside(o, p, ["key", "band", "day"]).select("id", "band", "n", F.round((F.col("total") + 5 * 200000) / (F.col("n") + 5), 6).alias("mean"))


LINES = "l AS (SELECT l_orderkey AS race, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS q, l_extendedprice AS p FROM lineitem)"


def runners(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))


@query(f"""
WITH {LINES}, s AS (SELECT *, q / sum(q) OVER w AS share, exp((0.6 * ln(q) + 0.4 * ln(p / 1000)) / 1.1) AS e FROM l WINDOW w AS (PARTITION BY race))
SELECT race, part, supp, line, round(share, 9) AS share, round(e / sum(e) OVER w, 6) AS blend, round(power(share, 1.18) / sum(power(share, 1.18)) OVER w, 6) AS sharpened FROM s WINDOW w AS (PARTITION BY race)
""")
def q_group_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    u = (0.6 * F.log("q") + 0.4 * F.log(F.col("p") / 1000)) / 1.1
    r = runners(spark, sf).withColumns({"share": W.share(F.col("q"), ["race"]), "blend": W.softmax(u, ["race"])})
    sharp = F.pow("share", F.lit(1.18))
    return r.select("race", "part", "supp", "line", F.round("share", 9).alias("share"), F.round("blend", 6).alias("blend"), F.round(W.share(sharp, ["race"]), 6).alias("sharpened"))


def _capped_sql(rounds: int = 5) -> str:
    w = "OVER (PARTITION BY race)"
    sql = f"WITH {LINES}, c0 AS (SELECT race, part, supp, line, slots, q / sum(q) {w} * slots AS v FROM (SELECT *, CASE WHEN count(*) {w} >= 7 THEN 3 WHEN count(*) {w} >= 4 THEN 2 ELSE 1 END AS slots FROM l))"
    for i in range(rounds):
        sql += f""", d{i} AS (SELECT *, sum(CASE WHEN v >= 0.98 THEN 0 ELSE v END) {w} AS free, sum(CASE WHEN v >= 0.98 THEN 0.98 ELSE 0 END) {w} AS held FROM c{i}),
c{i + 1} AS (SELECT race, part, supp, line, slots, CASE WHEN v >= 0.98 THEN 0.98 WHEN free > 0 THEN v * (slots - held) / free ELSE v END AS v FROM d{i})"""
    return sql + f" SELECT race, part, supp, line, slots::INT AS slots, round(least(v, 0.98), 9) AS place FROM c{rounds}"


@query(_capped_sql())
def q_capped_places(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("race"))
    r = runners(spark, sf).withColumns({"slots": F.when(n >= 7, 3).when(n >= 4, 2).otherwise(1), "v": F.col("q")})
    return W.capped(r, "v", ["race"], F.col("slots")).select("race", "part", "supp", "line", "slots", F.round("v", 9).alias("place"))


@query(f"""
WITH {Q} SELECT key, kind, arg_min(price, ts_us) AS opening, arg_max(price, ts_us) AS closing, CASE WHEN count(*) > 1 THEN round(arg_max(price, ts_us) - arg_min(price, ts_us), 4) END AS drift, count(*) AS depth, max(ts_us) - min(ts_us) AS span
FROM q GROUP BY 1, 2
""")
def q_open_close(spark: SparkSession, sf: str) -> DataFrame:
    g = quotes(spark, sf).groupBy("key", "kind").agg(F.min(F.struct("ts_us", "price")).alias("a"), F.max(F.struct("ts_us", "price")).alias("b"), F.count("*").alias("depth"))
    return g.select("key", "kind", F.col("a.price").alias("opening"), F.col("b.price").alias("closing"), F.when(F.col("depth") > 1, F.round(F.col("b.price") - F.col("a.price"), 4)).alias("drift"), "depth", (F.col("b.ts_us") - F.col("a.ts_us")).alias("span"))


@query(f"""
WITH {Q}, d AS (SELECT ts_us // {DAY} AS day, sum(CASE WHEN kind = 'view' THEN price / 50 - 1 ELSE -0.2 END) AS gain, count(*) AS n FROM q GROUP BY 1),
e AS (SELECT *, 100 + sum(gain) OVER (ORDER BY day) AS equity FROM d), p AS (SELECT *, greatest(100, max(equity) OVER (ORDER BY day)) AS peak FROM e)
SELECT day, n, round(equity, 4) AS equity, round(peak, 4) AS peak, round(peak - equity, 4) AS drawdown FROM p
""")
def q_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    gain = F.when(F.col("kind") == "view", F.col("price") / 50 - 1).otherwise(-0.2)
    days = quotes(spark, sf).groupBy(F.floor(F.col("ts_us") / DAY).cast("long").alias("day")).agg(F.sum(gain).alias("gain"), F.count("*").alias("n"))
    e = W.equity(days, "day", "gain")
    return e.select("day", "n", *[F.round(c, 4).alias(c) for c in ("equity", "peak", "drawdown")])


@query(f"WITH {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, id DESC) AS n FROM q) SELECT key, id, n::INT AS n FROM r WHERE n <= 20")
def q_newest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("ts_us"), F.desc("id"))
    return quotes(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 20").select("key", "id", "n")


@query(f"""
WITH {O}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS days FROM (SELECT DISTINCT day FROM o))
SELECT CASE WHEN n <= floor(days * 0.7) THEN 'train' WHEN n <= floor(days * 0.85) THEN 'tune' ELSE 'test' END AS part, count(*) AS n, min(o.day) AS first, max(o.day) AS last FROM o JOIN d USING (day) GROUP BY 1
""")
def q_time_split(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    days = o.groupBy("day").agg(F.count("*").alias("rows"))  # one row a day from here on
    ranked = days.withColumns({"n": F.row_number().over(Window.orderBy("day")), "days": F.count("*").over(Window.partitionBy())})
    part = F.when(F.col("n") <= F.floor(F.col("days") * 0.7), "train").when(F.col("n") <= F.floor(F.col("days") * 0.85), "tune").otherwise("test")
    return ranked.groupBy(part.alias("part")).agg(F.sum("rows").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations
""")
def q_fill_down(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"asked": F.when(F.col("role") == "user", F.col("turn"))}
    c = J.carried(table(spark, sf, "conversations"), ["conv_id"], F.floor(F.col("turn") / 64), ["turn", "role", "text"], asked)
    return c.select("conv_id", "turn", "asked")


@query(f"""
WITH {Q}, o AS (SELECT key, kind, arg_min(price, ts_us) AS a, arg_max(price, ts_us) AS b FROM q GROUP BY 1, 2),
s AS (SELECT key, kind, (1 / (1 + b)) / sum(1 / (1 + b)) OVER w - (1 / (1 + a)) / sum(1 / (1 + a)) OVER w AS move FROM o WINDOW w AS (PARTITION BY key))
SELECT key, kind, round(move, 6) AS move FROM s WHERE move >= 0.05
""")
def q_late_money(spark: SparkSession, sf: str) -> DataFrame:
    g = quotes(spark, sf).groupBy("key", "kind").agg(F.min(F.struct("ts_us", "price")).alias("a"), F.max(F.struct("ts_us", "price")).alias("b"))
    move = W.share(1 / (1 + F.col("b.price")), ["key"]) - W.share(1 / (1 + F.col("a.price")), ["key"])
    return g.select("key", "kind", move.alias("move")).where("move >= 0.05").withColumn("move", F.round("move", 6))


@query(f"""
WITH {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price DESC, ts_us, id) AS n FROM q) SELECT key, id, price FROM r WHERE n = 1
""")
def q_best_per_group(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.struct((-F.col("price")).alias("m"), "ts_us", "id", "price")).alias("b")  # map-side combined, unlike a window
    return quotes(spark, sf).groupBy("key").agg(best).select("key", "b.id", "b.price")
