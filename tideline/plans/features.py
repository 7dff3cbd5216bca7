"""Features of matches from earlier days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import joins as J
from ..operators import numbers, shots
from ..registry import query, table
from .joins import O, orders
from .scalars import DRAW_SQL, draws

M = f"{O}, m AS (SELECT id, day, CASE WHEN key % 3 = 0 THEN 'E1' ELSE 'E0' END AS division, key % 30 AS home, (key + 1 + id % 28) % 30 AS away, (id % 11)::DOUBLE AS home_n, (id // 3 % 9)::DOUBLE AS away_n FROM o)"
T = f"{M}, t AS (SELECT id, day, division, home AS team, true AS at_home, home_n AS scored FROM m UNION ALL SELECT id, day, division, away, false, away_n FROM m)"


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a match of two of thirty teams in one of two divisions."""
    k, i = F.col("key"), F.col("id")
    return orders(spark, sf).select(
        "id", "day", F.when(k % 3 == 0, "E1").otherwise("E0").alias("division"), (k % 30).alias("home"), ((k + 1 + i % 28) % 30).alias("away"),
        (i % 11).cast("double").alias("home_n"), (F.floor(i / 3) % 9).cast("double").alias("away_n"),
    )


@query(f"""
WITH {T}, p AS (SELECT a.id, a.team, b.scored, CASE WHEN b.division = 'E1' THEN 0.55 ELSE 1.0 END::DOUBLE AS w, row_number() OVER (PARTITION BY a.id, a.team ORDER BY b.day DESC, b.id DESC) AS r
  FROM t a JOIN t b ON a.team = b.team AND b.day < a.day),
g AS (SELECT *, max(r) OVER (PARTITION BY id, team) AS n FROM p WHERE r <= 6),
s AS (SELECT id, team, sum(scored * w * CASE WHEN n > 1 THEN power(0.45::DOUBLE, (r - 1) / (n - 1)::DOUBLE) ELSE 0.45 END) / sum(w * CASE WHEN n > 1 THEN power(0.45::DOUBLE, (r - 1) / (n - 1)::DOUBLE) ELSE 0.45 END) AS recent,
  (5.2 * 3 + sum(scored * w * power(0.88::DOUBLE, r - 1))) / (3 + sum(w * power(0.88::DOUBLE, r - 1))) AS decayed FROM g GROUP BY 1, 2)
SELECT t.id, t.team, round(coalesce(recent, 5.2), 6) AS recent, round(coalesce(decayed, 5.2), 6) AS decayed FROM t LEFT JOIN s ON t.id = s.id AND t.team = s.team
""")
def q_recency_means(spark: SparkSession, sf: str) -> DataFrame:
    t = X.sides(matches(spark, sf))
    p = X.past(t, ["team"], "day", "id", F.col("scored"), 6, F.when(F.col("division") == "E1", 0.55).otherwise(1.0))
    return J.beside(t, p, ["team", "day"]).select("id", "team", F.round(X.recency_mean(F.col("past"), 5.2), 6).alias("recent"), F.round(X.position_decayed_mean(F.col("past"), 5.2), 6).alias("decayed"))


@query(f"""
WITH {M}, p AS (SELECT a.id, a.day, b.day AS d, b.home_n + b.away_n AS total, row_number() OVER (PARTITION BY a.id ORDER BY b.day DESC, b.id DESC) AS r
  FROM m a JOIN m b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) AND b.day < a.day),
s AS (SELECT id, sum(total * power(0.5::DOUBLE, (day - d) / 365.0::DOUBLE)) / sum(power(0.5::DOUBLE, (day - d) / 365.0::DOUBLE)) AS met FROM p WHERE r <= 5 GROUP BY 1)
SELECT m.id, round(coalesce(met, 10.3), 6) AS met FROM m LEFT JOIN s USING (id)
""")
def q_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return X.meetings(matches(spark, sf)).withColumn("met", F.round("met", 6))


@query(f"""
WITH {M}, d AS (SELECT DISTINCT division, day FROM m),
p AS (SELECT d.division, d.day, b.home_n, b.away_n, row_number() OVER (PARTITION BY d.division, d.day ORDER BY b.day DESC, b.id DESC) AS r FROM d JOIN m b ON b.division = d.division AND b.day < d.day),
l AS (SELECT d.division, d.day, coalesce(avg(home_n), 5.5) AS h, coalesce(avg(away_n), 4.8) AS a FROM d LEFT JOIN p ON p.division = d.division AND p.day = d.day AND r <= 100 GROUP BY 1, 2)
SELECT x.day, round(x.h, 6) AS home, round(x.a, 6) AS away, round(greatest(0.85, least(1.15, (t.h + t.a) / (x.h + x.a))), 6) AS scale FROM l x JOIN l t ON t.division = 'E0' AND t.day = x.day WHERE x.division = 'E1'
""")
def q_division_scale(spark: SparkSession, sf: str) -> DataFrame:
    means = X.league_means(matches(spark, sf)).withColumn("all", F.col("home") + F.col("away"))
    top = means.where("division = 'E0'").select("day", F.col("all").alias("target"))
    low = means.where("division = 'E1'").join(top, "day")
    return low.select("day", F.round("home", 6).alias("home"), F.round("away", 6).alias("away"), F.round(X.division_scale(F.col("all"), F.col("target")), 6).alias("scale"))


@query(f"""
WITH {T}, d AS (SELECT DISTINCT team, day FROM t), g AS (SELECT team, day, count(*) FILTER (WHERE (division = 'E0')) AS top, count(*) FILTER (WHERE (division = 'E1')) AS low FROM t GROUP BY 1, 2),
s AS (SELECT d.team, d.day, coalesce(sum(top), 0) AS top, coalesce(sum(low), 0) AS low, coalesce(sum(top) FILTER (WHERE (g.day >= d.day - 420)), 0) AS top_now, coalesce(sum(low) FILTER (WHERE (g.day >= d.day - 420)), 0) AS low_now
  FROM d LEFT JOIN g ON g.team = d.team AND g.day BETWEEN d.day - 900 AND d.day - 1 GROUP BY 1, 2)
SELECT team, day, round(CASE WHEN top + low > 0 THEN low / (top + low)::DOUBLE ELSE 0 END, 6) AS share, (low_now >= 8 AND top_now < 8)::INT AS promoted FROM s
""")
def q_standing(spark: SparkSession, sf: str) -> DataFrame:
    t = X.sides(matches(spark, sf))
    return X.standing(t, "E1").withColumn("share", F.round("share", 6))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), r AS (SELECT numbers, row_number() OVER (ORDER BY draw_id) AS i FROM d), n AS (SELECT count(*) AS n FROM d),
c AS (SELECT unnest(range(200, n + 1, 100)) AS cut FROM n), x AS (SELECT i, unnest(numbers) AS number FROM r)
SELECT cut, number, count(*) AS seen, count(*) * 49 / (cut * 6.0::DOUBLE) AS bias FROM c JOIN x ON x.i <= cut GROUP BY 1, 2
""")
def q_expanding_bias(spark: SparkSession, sf: str) -> DataFrame:
    d = draws(spark, sf)
    n = d.count()
    at = numbers.numbered(d, "draw_id").withColumn("i", F.col("i") + 1)
    # each number's count in the step that a draw falls in, then added up over steps
    step = F.greatest(F.lit(200), F.ceil(F.col("i") / 100) * 100).alias("cut")
    by_step = at.where(F.col("i") <= n - n % 100).select(step, F.explode("numbers").alias("number")).groupBy("cut", "number").agg(F.count("*").alias("n"))
    grid = spark.range(200, n + 1, 100).select(F.col("id").alias("cut"), F.explode(F.sequence(F.lit(1), F.lit(49))).alias("number"))
    filled = grid.join(by_step, ["cut", "number"], "left")
    seen = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("number").orderBy("cut"))
    return filled.select("cut", "number", seen.alias("seen")).where("seen > 0").select("cut", "number", "seen", (F.col("seen") * 49 / (F.col("cut") * 6.0)).alias("bias"))


SPACING_SQL = f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), g AS (SELECT * FROM (SELECT unnest(list_transform(range(1, 6), lambda i: numbers[(i + 1)::INT] - numbers[i::INT])) AS gap FROM d) WHERE gap IS NOT NULL),
m AS (SELECT avg(gap) AS mean, count(*) AS n FROM g), k AS (SELECT gap, count(*) AS c FROM g GROUP BY 1),
e AS (SELECT gap / mean AS s, c, n, sum(c) OVER (ORDER BY gap) AS upto FROM k, m)
SELECT max(n) AS n, round(max(greatest(abs(upto / n::DOUBLE - (1 - exp(-s))), abs(1 - exp(-s) - (upto - c) / n::DOUBLE))), 6) AS exponential,
  round(max(greatest(abs(upto / n::DOUBLE - (1 - exp(-pi() / 4 * s * s))), abs(1 - exp(-pi() / 4 * s * s) - (upto - c) / n::DOUBLE))), 6) AS wigner,
  round(sum(c * (ln(pi() / 2 * s * exp(-pi() / 4 * s * s)) + s)) / max(n), 6) AS bayes FROM e WHERE s > 0
"""


@query(SPACING_SQL)
def q_spacing_ks(spark: SparkSession, sf: str) -> DataFrame:
    """Kolmogorov distances of spacings over their mean, and the mean log Bayes factor; sums run over the few distinct spacings."""
    gaps = draws(spark, sf).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.get("numbers", i) - F.get("numbers", i - 1))).alias("gap")).where("gap is not null")
    by_gap = gaps.groupBy("gap").agg(F.count("*").alias("c"))  # 44 at most
    every = Window.partitionBy()
    n = F.sum("c").over(every)
    e = by_gap.select("c", n.alias("n"), (F.col("gap") / (F.sum(F.col("gap") * F.col("c")).over(every) / n)).alias("s"), F.sum("c").over(Window.orderBy("gap")).alias("upto")).where("s > 0")
    wide = lambda cdf: F.max(F.greatest(F.abs(F.col("upto") / F.col("n") - cdf), F.abs(cdf - (F.col("upto") - F.col("c")) / F.col("n"))))
    s, quarter = F.col("s"), F.pi() / 4
    likelier = F.log(2 * quarter * s * F.exp(-quarter * s * s)) + s
    return e.agg(F.max("n").alias("n"), F.round(wide(1 - F.exp(-s)), 6).alias("exponential"), F.round(wide(1 - F.exp(-quarter * s * s)), 6).alias("wigner"), F.round(F.sum(F.col("c") * likelier) / F.max("n"), 6).alias("bayes"))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), c AS (SELECT unnest(numbers) AS number, count(*) AS seen FROM d GROUP BY 1), t AS (SELECT sum(seen) AS t, count(*) AS k FROM c)
SELECT number, seen, round((seen - t / 49.0::DOUBLE) * (seen - t / 49.0::DOUBLE) / (t / 49.0::DOUBLE), 6) AS chi, round(seen / t::DOUBLE * ln(seen / t::DOUBLE * 49), 8) AS kl, round((seen + 1) / (t + 49)::DOUBLE, 8) AS posterior FROM c, t
""")
def q_number_tests(spark: SparkSession, sf: str) -> DataFrame:
    c = draws(spark, sf).select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("seen"))  # 49 rows
    total = F.sum("seen").over(Window.partitionBy())
    seen, p = F.col("seen"), F.col("seen") / F.col("t")
    even = F.col("t") / 49.0
    return c.withColumn("t", total).select("number", "seen", F.round((seen - even) * (seen - even) / even, 6).alias("chi"), F.round(p * F.log(p * 49), 8).alias("kl"), F.round((seen + 1) / (F.col("t") + 49), 8).alias("posterior"))


@query("""
SELECT p_partkey AS id, round(lgamma((p_size % 50 + 1) / 4.0::DOUBLE), 6) AS log_gamma, round(lgamma(p_partkey + 1), 4) AS log_factorial FROM part
""")
def q_log_gamma(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.special import log_gamma

    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(log_gamma((F.col("p_size") % 50 + 1) / 4.0), 6).alias("log_gamma"), F.round(log_gamma(F.col("p_partkey") + 1.0), 4).alias("log_factorial"))


RECENCY = "w * CASE WHEN n > 1 THEN power(0.45::DOUBLE, (r - 1) / (n - 1)::DOUBLE) ELSE 0.45 END"


@query(f"""
WITH {T}, d AS (SELECT DISTINCT day FROM m),
l AS (SELECT d.day, home_n, away_n, row_number() OVER (PARTITION BY d.day ORDER BY m.day DESC, m.id DESC) AS r FROM d JOIN m ON m.division = 'E0' AND m.day < d.day),
v AS (SELECT d.day, (coalesce(avg(home_n), 5.5) + coalesce(avg(away_n), 4.8)) / 2 AS level FROM d LEFT JOIN (SELECT * FROM l WHERE r <= 100) l USING (day) GROUP BY 1),
s AS (SELECT a.id, a.day, a.team, a.scored, CASE WHEN a.division = 'E1' THEN 0.55 ELSE 1.0 END::DOUBLE AS w, b.team AS opponent, b.scored AS conceded FROM t a JOIN t b ON a.id = b.id AND a.at_home <> b.at_home),
td AS (SELECT DISTINCT team, day FROM t), p AS (SELECT td.team, td.day, conceded, w, row_number() OVER (PARTITION BY td.team, td.day ORDER BY s.day DESC, s.id DESC) AS r FROM td JOIN s ON s.team = td.team AND s.day < td.day),
g AS (SELECT *, max(r) OVER (PARTITION BY team, day) AS n FROM p WHERE r <= 20), c AS (SELECT team, day, sum(conceded * {RECENCY}) / sum({RECENCY}) AS given FROM g GROUP BY 1, 2),
x AS (SELECT s.*, level, greatest(0.7, least(1.4, level / greatest(coalesce(given, level), 0.5))) AS scale FROM s JOIN v USING (day) LEFT JOIN c ON c.team = s.opponent AND c.day = s.day),
q AS (SELECT td.team, td.day, scored * scale AS y, w, row_number() OVER (PARTITION BY td.team, td.day ORDER BY x.day DESC, x.id DESC) AS r FROM td JOIN x ON x.team = td.team AND x.day < td.day),
h AS (SELECT *, max(r) OVER (PARTITION BY team, day) AS n FROM q WHERE r <= 5), e AS (SELECT team, day, sum(y * {RECENCY}) / sum({RECENCY}) AS adjusted FROM h GROUP BY 1, 2)
SELECT x.id, x.team, round(scale, 6) AS scale, round(coalesce(adjusted, level), 6) AS adjusted FROM x LEFT JOIN e USING (team, day)
""")
def q_adjusted_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = shots.adjusted(matches(spark, sf))
    return a.select("id", "team", F.round("scale", 6).alias("scale"), F.round("adjusted", 6).alias("adjusted"))
