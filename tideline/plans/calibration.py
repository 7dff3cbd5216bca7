"""Calibration by key, and corrections to market prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..registry import query
from .joins import Q, quotes

#: Events as settled forecasts of keys of very different sizes: key 0 has most of them, others a few dozen.
K = f"{Q}, k AS (SELECT id, ts_us, CASE WHEN key % 4 <> 0 THEN 0 WHEN key % 8 = 0 THEN 1 + key % 5 ELSE 10 + key % 97 END AS key, (5 + id % 91) / 100.0::DOUBLE AS p, ((id * 37 + key) % 100 < 20 + (5 + id % 91) * 0.6)::INT AS y, (10 + (id * 7) % 80) / 100.0::DOUBLE AS market FROM q)"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("id"), F.col("key")
    key = F.when(k % 4 != 0, 0).when(k % 8 == 0, 1 + k % 5).otherwise(10 + k % 97)
    y = ((i * 37 + k) % 100 < 20 + (5 + i % 91) * 0.6).cast("int")
    return quotes(spark, sf).select("id", "ts_us", key.cast("long").alias("key"), ((5 + i % 91) / 100.0).alias("p"), y.alias("y"), ((10 + (i * 7) % 80) / 100.0).alias("market"))


LADDER = f"""
WITH RECURSIVE {K}, n AS (SELECT key, count(*) AS n FROM k GROUP BY 1), c AS (SELECT key, p, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS h FROM k GROUP BY 1, 2),
cum AS (SELECT key, p, row_number() OVER (PARTITION BY key ORDER BY p) AS i, sum(w) OVER (PARTITION BY key ORDER BY p) AS w, sum(h) OVER (PARTITION BY key ORDER BY p) AS h FROM c JOIN n USING (key) WHERE n >= 200),
part AS (SELECT a.key, coalesce(b.i, 0) + 1 AS j, a.i AS k, (a.h - coalesce(b.h, 0)) / (a.w - coalesce(b.w, 0)) AS v FROM cum a JOIN (SELECT key, i, w, h FROM cum UNION ALL SELECT DISTINCT key, 0, 0, 0 FROM cum) b ON a.key = b.key AND b.i < a.i),
low AS (SELECT key, j, k AS i, min(v) OVER (PARTITION BY key, j ORDER BY k DESC) AS v FROM part),
iso AS (SELECT l.key, cum.p, max(l.v) AS v FROM low l JOIN cum ON cum.key = l.key AND cum.i = l.i GROUP BY 1, 2),
tk AS (SELECT key, sum(w) AS size, list(ln(p / (1 - p))) AS z, list(w) AS w, list(h) AS h FROM c JOIN n USING (key) WHERE n BETWEEN 50 AND 199 GROUP BY key),
t AS (SELECT key, 0 AS step, 1.0::DOUBLE AS t, 0.0::DOUBLE AS b FROM tk
  UNION ALL SELECT key, step + 1, greatest(0.25, least(6.0, t + 0.05 * list_sum(list_transform(range(1, len(z) + 1), lambda i: e[i] * z[i])) / (t * t) / size)), b - 0.05 * list_sum(e) / size
  FROM (SELECT t.key, t.step, t.t, t.b, tk.size, tk.z, list_transform(range(1, len(tk.z) + 1), lambda i: tk.w[i] / (1 + exp(-(tk.z[i] / t.t + t.b))) - tk.h[i]) AS e FROM t JOIN tk USING (key) WHERE step < 400))
"""


@query(LADDER + """
SELECT id, round(CASE WHEN n < 50 THEN p WHEN n < 200 THEN 1 / (1 + exp(-(ln(p / (1 - p)) / t.t + t.b))) ELSE iso.v END, 6) AS calibrated
FROM k JOIN n USING (key) LEFT JOIN iso USING (key, p) LEFT JOIN t ON t.key = k.key AND t.step = 400
""")
def q_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Every forecast as its key's calibrator has it: as it is, scaled, or isotonic."""
    s = samples(spark, sf)
    return C.calibrated(s, C.ladder(s, ["key"], "p", "y"), ["key"], "p").select("id", F.round("calibrated", 6).alias("calibrated"))


@query(f"""
WITH {K}, b AS (SELECT key, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS p, sum(y) AS y, sum((p - y) ** 2) AS e FROM k GROUP BY 1, 2),
g AS (SELECT key, sum(n)::BIGINT AS n, sum(y) / sum(n)::DOUBLE AS base_rate, sum(e) / sum(n) AS brier, sum(abs(y - p)) / sum(n) AS expected_error, max(abs(y - p) / n) AS maximum_error FROM b GROUP BY 1)
SELECT key, n, round(base_rate, 9) AS base_rate, round(brier, 9) AS brier, round(expected_error, 9) AS expected_error, round(maximum_error, 9) AS maximum_error, n >= 50 AS reliable,
  n >= 50 AND CASE WHEN base_rate * (1 - base_rate) > 0 THEN (base_rate * (1 - base_rate) - brier) / (base_rate * (1 - base_rate)) ELSE 0 END > 1 / sqrt(n) AS beats FROM g
""")
def q_calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    r = C.report(samples(spark, sf), ["key"], "p", "y")
    return r.select("key", "n", *[F.round(c, 9).alias(c) for c in ("base_rate", "brier", "expected_error", "maximum_error")], "reliable", "beats")


@query(f"""
WITH RECURSIVE {K}, u AS (SELECT key, y::DOUBLE AS y, market AS q, ln(market / (1 - market)) AS z, greatest(-2, least(2, ln(p / (1 - p)) - ln(market / (1 - market)))) AS gap, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM k),
s AS (SELECT *, i <= greatest(1, floor(n * 0.7 + 1e-9)) AS learns FROM u),
d AS (SELECT key, sum(w) AS size, list(z) AS z, list(gap) AS g, list(w) AS w, list(h) AS h FROM (SELECT key, z, gap, count(*)::DOUBLE AS w, sum(y) AS h FROM s WHERE learns AND n >= 60 GROUP BY 1, 2, 3) GROUP BY key),
f AS (SELECT key, 0 AS step, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w FROM d
  UNION ALL SELECT key, step + 1, b - 0.08 * (list_sum(e) / size + 0.05 * b), w - 0.08 * (list_sum(list_transform(range(1, len(g) + 1), lambda i: e[i] * g[i])) / size + 0.05 * w)
  FROM (SELECT f.key, f.step, f.b, f.w, d.size, d.g, list_transform(range(1, len(d.z) + 1), lambda i: d.w[i] / (1 + exp(-(d.z[i] + f.b + f.w * d.g[i]))) - d.h[i]) AS e FROM f JOIN d USING (key) WHERE step < 400)),
m AS (SELECT key, b, w FROM f WHERE step = 400), x AS (SELECT s.*, b, w, 1 / (1 + exp(-(z + b + w * gap))) AS p FROM s JOIN m USING (key) WHERE NOT learns),
r AS (SELECT key, count(*) AS holdout, avg((p - y) ** 2) AS brier, avg((q - y) ** 2) AS market_brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS market_log_loss FROM x GROUP BY 1)
SELECT key, n.n, coalesce(holdout, 0) AS holdout, round(coalesce(b, 0), 6) AS bias, round(coalesce(w, 0), 6) AS weight, round(coalesce(brier, 0), 6) AS brier, round(coalesce(market_brier, 0), 6) AS market_brier, round(coalesce(log_loss, 0), 6) AS log_loss,
  coalesce(brier < market_brier AND log_loss < market_log_loss, false) AS adopted FROM (SELECT key, count(*) AS n FROM u GROUP BY 1) n LEFT JOIN m USING (key) LEFT JOIN r USING (key)
""")
def q_market_residuals(spark: SparkSession, sf: str) -> DataFrame:
    r = C.residuals(samples(spark, sf), ["key"], "p", "market", "y")
    return r.select("key", "n", "holdout", *[F.round(c, 6).alias(c) for c in ("bias", "weight", "brier", "market_brier", "log_loss")], "adopted")
