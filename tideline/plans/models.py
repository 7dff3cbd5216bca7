"""Models, folds of rows and calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import champion
from ..operators import models as M
from ..operators import numbers
from ..operators import windows as W
from ..operators.places import paid, place_probabilities
from ..registry import query, table
from ..sources import store
from .aggregates import P_SQL, forecasts
from .joins import O, orders
from .scalars import DRAW_SQL, draws
from .windows import LINES, runners


@query(f"""
WITH {O}, d AS (SELECT day, rows, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS days FROM (SELECT day, count(*) AS rows FROM o GROUP BY 1)),
x AS (SELECT *, floor(days * 0.5) + floor((days - floor(days * 0.5)) / 4.0::DOUBLE * fold) AS lo, floor(days * 0.5) + floor((days - floor(days * 0.5)) / 4.0::DOUBLE * (fold + 1)) AS hi FROM d CROSS JOIN range(0, 4) t(fold)),
e AS (SELECT *, min(CASE WHEN i > lo THEN day END) OVER (PARTITION BY fold) AS b, max(CASE WHEN i <= hi THEN day END) OVER (PARTITION BY fold) AS e FROM x),
p AS (SELECT fold, rows, day, CASE WHEN day < b - 10 THEN 'train' WHEN day >= b + CASE WHEN fold > 0 THEN 3 ELSE 0 END AND day <= e THEN 'test' END AS part FROM e)
SELECT fold::INT AS fold, part, sum(rows)::BIGINT AS rows, min(day) AS first, max(day) AS last FROM p WHERE part IS NOT NULL GROUP BY 1, 2
""")
def q_purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    f = M.folds(orders(spark, sf), "day")
    return f.groupBy("fold", "part").agg(F.sum("rows").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


@query(f"""
WITH {LINES}, s AS (SELECT race, part, supp, line, q / sum(q) OVER (PARTITION BY race) AS p, count(*) OVER (PARTITION BY race) AS n FROM l)
SELECT race, part, supp, line, round(p + p * (sum(p / (1 - p)) OVER (PARTITION BY race) - p / (1 - p)), 6) AS first_two FROM s WHERE n > 1
""")
def q_place_expansion(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("race"))
    r = runners(spark, sf).withColumns({"p": W.share(F.col("q"), ["race"]), "n": n}).where("n > 1")
    return r.select("race", "part", "supp", "line", F.round(M.second_place(F.col("p"), ["race"]), 6).alias("first_two"))


PLACES = f"""
WITH {LINES}, n AS (SELECT DISTINCT * FROM l), s AS (SELECT *, q / sum(q) OVER w AS a, power(q / sum(q) OVER w, 0.86) AS v, count(*) OVER w AS n, row_number() OVER (PARTITION BY race ORDER BY part, supp, line, p) AS i FROM n WINDOW w AS (PARTITION BY race)),
t AS (SELECT *, sum(v) OVER (PARTITION BY race) AS t, CASE WHEN n >= 7 THEN 3 WHEN n >= 4 THEN 2 ELSE 0 END AS slots FROM s),
two AS (SELECT x.race, x.i, sum(y.a * x.v / (y.t - y.v)) AS second FROM t x JOIN t y ON x.race = y.race AND x.i <> y.i GROUP BY 1, 2),
three AS (SELECT x.race, x.i, sum(y.a * z.v / (y.t - y.v) * x.v / (y.t - y.v - z.v)) AS third FROM t x JOIN t y ON x.race = y.race AND x.i <> y.i JOIN t z ON z.race = x.race AND z.i NOT IN (x.i, y.i) WHERE x.slots = 3 GROUP BY 1, 2)
"""


@query(PLACES + """SELECT race, part, supp, line, round(p, 2) AS p, CASE WHEN slots = 0 THEN 0 WHEN slots = 2 THEN round(a + second, 9) ELSE round(a + second + third, 9) END AS place FROM t LEFT JOIN two USING (race, i) LEFT JOIN three USING (race, i)""")
def q_place_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    r = runners(spark, sf).distinct().withColumn("win", W.share(F.col("q"), ["race"]))
    out = place_probabilities(r, ["race"], ["part", "supp", "line", "p"], "win", power=0.86)
    return out.select("race", "part", "supp", "line", F.round("p", 2).alias("p"), F.round("place", 9).alias("place"))


@query(PLACES + """, f AS (SELECT race, part, supp, line, p, a AS win, CASE WHEN slots = 0 THEN 0 WHEN slots = 2 THEN a + second ELSE a + second + third END AS place FROM t LEFT JOIN two USING (race, i) LEFT JOIN three USING (race, i))
SELECT race, (row_number() OVER (PARTITION BY race ORDER BY win DESC, part, supp, line, p) - 1)::INT AS rank, part, supp, line, round(win, 6) AS win, round(place, 6) AS place FROM f
""")
def q_race_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every race's runners with their chances, the likeliest winner first."""
    r = runners(spark, sf).distinct().withColumn("win", W.share(F.col("q"), ["race"]))
    out = place_probabilities(r, ["race"], ["part", "supp", "line", "p"], "win", power=0.86)
    cards = champion.assembled(out, ["race"], ["part", "supp", "line", "p"])
    return cards.select("race", F.posexplode("runners").alias("rank", "r")).select("race", "rank", "r.part", "r.supp", "r.line", "r.win", "r.place")


@query()
def q_champion(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a challenger passes the gates against the baseline, for winners and places: one row."""
    r = runners(spark, sf).distinct().join(orders(spark, sf).select(F.col("id").alias("race"), "day"), "race")
    w = Window.partitionBy("race")
    finish = F.row_number().over(w.orderBy(F.desc(F.col("p") + 40000 * F.sin(F.col("part"))), "part", "supp", "line", "p"))
    r = r.withColumns({"finish": finish, "size": F.count("*").over(w)}).where("size > 1")
    known = {c: F.abs(F.sin(F.col("part") * (i + 1))) for i, c in enumerate(champion.BASELINE)}
    r = r.withColumns({"won": (F.col("finish") == 1).cast("int"), "placed": (F.col("finish") <= paid(F.col("size"))).cast("int"), "place_rate": (1 + F.col("supp") % 5) / 10, **known})
    figures, _ = champion.trained(r, ["p", "q"], "race", "day", "won", "placed", "place_rate")
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in figures.items()))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), s AS (SELECT list_sum(numbers)::BIGINT AS s, count(*) AS n FROM d GROUP BY 1)
SELECT s, n, round((sum(n) OVER (ORDER BY s) - n) / (sum(n) OVER ())::DOUBLE, 6) AS below FROM s
""")
def q_rarity(spark: SparkSession, sf: str) -> DataFrame:
    s = draws(spark, sf).select(F.aggregate("numbers", F.lit(0).cast("long"), lambda a, x: a + x).alias("s")).groupBy("s").agg(F.count("*").alias("n"))  # at most 280 sums
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("s", "n", F.round(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.sum("n").over(Window.partitionBy()), 6).alias("below"))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), m AS (SELECT max(draw_id) AS m FROM d), x AS (SELECT draw_id, unnest(numbers) AS n FROM d),
c AS (SELECT n, count(*) + 1 AS a, count(*) FILTER (WHERE draw_id > m - 200) + 1 AS b, m - max(draw_id) AS gap FROM x, m GROUP BY n, m)
SELECT n, round(0.5 * a / sum(a) OVER () + 0.3 * b / sum(b) OVER () + 0.2 * (1 + gap) / sum(1 + gap) OVER (), 6) AS score FROM c
""")
def q_number_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    d = draws(spark, sf)
    newest = d.agg(F.max("draw_id").alias("m"))  # one row
    x = d.select("draw_id", F.explode("numbers").alias("n")).join(F.broadcast(newest))
    c = x.groupBy("n").agg((F.count("*") + 1).alias("a"), (F.count(F.when(F.col("draw_id") > F.col("m") - 200, 1)) + 1).alias("b"), (F.max("m") - F.max("draw_id") + 1).alias("g"))  # 49 rows
    every = Window.partitionBy()
    part = lambda k: F.col(k) / F.sum(k).over(every)
    return c.select("n", F.round(0.5 * part("a") + 0.3 * part("b") + 0.2 * part("g"), 6).alias("score"))


#: Forecasts, by league, pooled on the grid that the fits use.
GRID = f"{P_SQL.strip()}, c AS (SELECT key % 5 AS league, round(p * 10000) / 10000 AS p, count(*) AS n, sum(y)::DOUBLE AS h FROM p GROUP BY 1, 2)"


@query(GRID + """,
cum AS (SELECT league, p, n, row_number() OVER w AS i, sum(n) OVER w AS sn, sum(h) OVER w AS sh FROM c WINDOW w AS (PARTITION BY league ORDER BY p)),
part AS (SELECT a.league, coalesce(b.i, 0) + 1 AS j, a.i AS k, (a.sh - coalesce(b.sh, 0)) / (a.sn - coalesce(b.sn, 0)) AS v FROM cum a JOIN (SELECT league, i, sn, sh FROM cum UNION ALL SELECT DISTINCT league, 0, 0, 0 FROM cum) b ON a.league = b.league AND b.i < a.i),
low AS (SELECT league, j, k AS i, min(v) OVER (PARTITION BY league, j ORDER BY k DESC) AS v FROM part)
SELECT cum.league, cum.p, cum.n, round(max(low.v), 6) AS fitted FROM low JOIN cum USING (league, i) GROUP BY 1, 2, 3
""")
def q_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return M.isotonic(forecasts(spark, sf).withColumn("league", F.col("key") % 5), ["league"], "p", "y").withColumn("fitted", F.round("fitted", 6))


@query(GRID.replace("WITH", "WITH RECURSIVE", 1) + """,
a AS (SELECT list(ln(p / (1 - p))) AS z, list(n) AS n, sum(h * ln(p / (1 - p))) AS hz FROM (SELECT p, sum(n) AS n, sum(h) AS h FROM c GROUP BY p)),
t AS (SELECT 0 AS step, 1 / 6.0::DOUBLE AS low, 4.0::DOUBLE AS high
  UNION ALL SELECT step + 1, CASE WHEN slope > 0 THEN low ELSE b END, CASE WHEN slope > 0 THEN b ELSE high END
  FROM (SELECT *, list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i] * n[i] / (1 + exp(-b * z[i])))) - hz AS slope FROM (SELECT *, (low + high) / 2 AS b FROM t, a WHERE step < 60)))
SELECT id, round(1 / (1 + exp(-ln(p / (1 - p)) * (low + high) / 2)), 6) AS calibrated FROM p, t WHERE step = 60
""")
def q_temperature(spark: SparkSession, sf: str) -> DataFrame:
    f = forecasts(spark, sf)
    t = M.temperature(f, "p", "y")
    p = 1 / (1 + F.exp(-F.log(F.col("p") / (1 - F.col("p"))) / t))
    return f.select("id", F.round(p, 6).alias("calibrated"))


REGRESSION = """
WITH RECURSIVE r AS (SELECT l_orderkey AS k, count(*)::DOUBLE AS y, avg(l_discount * 10) AS a, avg(l_tax * 10) AS b FROM lineitem GROUP BY 1),
w AS (SELECT 0 AS step, ln(greatest((SELECT avg(y) FROM r), 1e-6)) AS c, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v
  UNION ALL SELECT step + 1, c + 0.025 * g0, u + 0.025 * (g1 - 0.003 * u), v + 0.025 * (g2 - 0.003 * v)
  FROM (SELECT step, c, u, v, avg(e) AS g0, avg(e * a) AS g1, avg(e * b) AS g2 FROM (SELECT w.*, r.a, r.b, greatest(-4, least(4, y - exp(c + u * r.a + v * r.b))) AS e FROM w, r WHERE step < 30) GROUP BY step, c, u, v))
SELECT k, round(exp(c + u * a + v * b), 6) AS expected FROM r, w WHERE step = 30
"""


@query(REGRESSION)
def q_count_regression(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("double").alias("y"), F.avg(F.col("l_discount") * 10).alias("a"), F.avg(F.col("l_tax") * 10).alias("b"))
    w = M.count_regression(rows, ["a", "b"], "y")
    return rows.select("k", F.round(F.exp(w[0] + F.col("a") * w[1] + F.col("b") * w[2]), 6).alias("expected"))


@query(REGRESSION)
def q_resumed_training(spark: SparkSession, sf: str) -> DataFrame:
    """The same regression by steps that are kept in the shared folder, stopped half way, taken up again and activated."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("double").alias("y"), F.avg(F.col("l_discount") * 10).alias("a"), F.avg(F.col("l_tax") * 10).alias("b"))
    kept, data = store.Store(spark, store.shared(spark, "training")), store.fingerprint(rows.select("k", "y"))
    few = rows.select("a", "b", "y").persist()
    try:
        start = lambda: {"w": [float(math.log(max(few.agg(F.avg("y")).first()[0] or 0.0, 1e-6))), 0.0, 0.0]}
        step = lambda s: {"w": M.gradient_step(few, ["a", "b"], "y", s["w"], 0.025, 0.003)}
        for epochs in (15, 30):
            model = store.resumed(kept, data, start, step, epochs)
    finally:
        few.unpersist()
    store.activate(kept, model, data, store.fingerprint(rows.select("k", "y")), lambda m: len(m["w"]) == 3)
    w = store.active(kept)["model"]["w"]
    kept.delete()
    return rows.select("k", F.round(F.exp(w[0] + F.col("a") * w[1] + F.col("b") * w[2]), 6).alias("expected"))


@query(f"""
WITH RECURSIVE {LINES}, x AS (SELECT *, q / 50 AS a, p / 100000 AS b, max((p, part, supp, line)) OVER (PARTITION BY race) AS top FROM l), r AS (SELECT race, part, supp, line, a, b, ((p, part, supp, line) = top)::INT AS won FROM x),
w AS (SELECT 0 AS step, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v
  UNION ALL SELECT step + 1, u + 0.045 * (g1 / n - 0.004 * u), v + 0.045 * (g2 / n - 0.004 * v)
  FROM (SELECT step, u, v, sum((won - e / s) * a) AS g1, sum((won - e / s) * b) AS g2, count(DISTINCT race) AS n
    FROM (SELECT *, sum(e) OVER (PARTITION BY race) AS s FROM (SELECT w.*, r.race, r.a, r.b, r.won, exp(u * r.a + v * r.b) AS e FROM w, r WHERE step < 60)) GROUP BY step, u, v))
SELECT race, part, supp, line, round(exp(u * a + v * b) / sum(exp(u * a + v * b)) OVER (PARTITION BY race), 6) AS p FROM r, w WHERE step = 60
""")
def q_conditional_logit(spark: SparkSession, sf: str) -> DataFrame:
    r = runners(spark, sf).withColumns({"a": F.col("q") / 50, "b": F.col("p") / 100000})
    top = F.max(F.struct("p", "part", "supp", "line")).over(Window.partitionBy("race"))
    r = r.withColumn("won", (F.struct("p", "part", "supp", "line") == top).cast("int"))
    w = M.conditional_logit(r, "race", ["a", "b"], "won")
    return r.select("race", "part", "supp", "line", F.round(W.softmax(F.col("a") * w[0] + F.col("b") * w[1], ["race"]), 6).alias("p"))


def dated_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The draws in order, with the weekday and price of their order as day and turnover."""
    o = draws(spark, sf, weekday=F.weekday("o_orderdate"), turnover=F.col("o_totalprice"))
    return numbers.numbered(o.where("draw_id is not null"), "draw_id")


@query()
def q_number_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Every draw from the hundredth on as nine models, weighed by their past, would have guessed it."""
    return numbers.tested(dated_draws(spark, sf))


@query()
def q_backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The same with weights that stay: one row."""
    return numbers.summary(numbers.tested(dated_draws(spark, sf), correcting=False))
