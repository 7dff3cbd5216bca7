"""Ordered folds, and states that windows can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import DAY
from ..operators import folds, joins
from ..registry import query, table
from .joins import O, Q, orders, quotes


# a row of s holds a league's ratings as of its day's start and what the day has moved so far, as lists over teams
@query(f"""
WITH RECURSIVE {O}, m AS (SELECT key % 5 AS league, day, id, key % 40 + 1 AS home, (key * 7 + id) % 40 + 41 AS away, CASE WHEN price > 300000 THEN 1.0 WHEN price > 200000 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY day, id) AS i FROM m), z AS (SELECT list_transform(range(80), lambda x: 1500.0::DOUBLE) AS start, list_transform(range(80), lambda x: 0.0::DOUBLE) AS zero),
s AS (SELECT DISTINCT league, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS day, start AS now, zero AS moved, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM r, z
  UNION ALL SELECT league, i, id, day, now, list_transform(moved, lambda v, k: CASE k WHEN home THEN v + 20 * (score - 1 / (1 + 10 ** ((y - x - 60) / 400))) WHEN away THEN v - 20 * (score - 1 / (1 + 10 ** ((y - x - 60) / 400))) ELSE v END), x, y
  FROM (SELECT *, now[home] AS x, now[away] AS y FROM (SELECT r.*, CASE WHEN r.day IS DISTINCT FROM s.day THEN list_transform(s.now, lambda v, k: v + s.moved[k]) ELSE s.now END AS now,
      CASE WHEN r.day IS DISTINCT FROM s.day THEN list_transform(s.moved, lambda v: 0.0::DOUBLE) ELSE s.moved END AS moved FROM s JOIN r ON r.league = s.league AND r.i = s.i + 1)))
SELECT id, round(x, 4) AS before_home, round(y, 4) AS before_away FROM s WHERE i > 0
""")
def q_ratings(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    rows = o.select((F.col("key") % 5).alias("league"), "day", "id", (F.col("key") % 40).alias("home"), ((F.col("key") * 7 + F.col("id")) % 40 + 40).alias("away"), F.when(F.col("price") > 300000, 1.0).when(F.col("price") > 200000, 0.5).otherwise(0.0).alias("score"))
    r = folds.rating(rows)
    return r.select("id", F.round("before_home", 4).alias("before_home"), F.round("before_away", 4).alias("before_away"))


@query(f"""
WITH RECURSIVE {Q}, r AS (SELECT key, id, price / 500 AS x, (id % 7 - 3) / 20.0::DOUBLE AS d, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM q),
s AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS id, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS cum, 0.0::DOUBLE AS low, 0 AS m, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS drifted, false AS degraded, false AS improved FROM r WHERE i = 1
  UNION ALL SELECT key, i, id, CASE WHEN drifted THEN 0 ELSE n END, CASE WHEN drifted THEN 0 ELSE mean END, CASE WHEN drifted THEN 0 ELSE cum END, CASE WHEN drifted THEN 0 ELSE low END,
    CASE WHEN degraded OR improved THEN 0 ELSE m END, CASE WHEN degraded OR improved THEN 0 ELSE up END, CASE WHEN degraded OR improved THEN 0 ELSE down END, drifted, degraded, improved
  FROM (SELECT *, n >= 20 AND cum - low > 0.35 AS drifted, m >= 20 AND up > 0.25 AS degraded, m >= 20 AND down < -0.25 AS improved
    FROM (SELECT *, least(low0, cum) AS low FROM (SELECT key, i, id, n, mean, cum0 + x - mean - 0.005 AS cum, low0, m, greatest(0, up0 + d - 0.004) AS up, least(0, down0 + d + 0.004) AS down
      FROM (SELECT r.key, r.i, r.id, r.x, r.d, s.n + 1 AS n, s.mean + (r.x - s.mean) / (s.n + 1) AS mean, s.cum AS cum0, s.low AS low0, s.m + 1 AS m, s.up AS up0, s.down AS down0 FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1)))))
SELECT key, id, drifted, degraded, improved FROM s WHERE i > 0
""")
def q_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return folds.alarms(quotes(spark, sf).select("key", "ts_us", "id", (F.col("price") / 500).alias("loss"), ((F.col("id") % 7 - 3) / 20.0).alias("difference")))


@query(f"""
WITH RECURSIVE {Q}, r AS (SELECT key, id, (kind = 'view')::DOUBLE AS y, (1 + id % 97) / 99.0::DOUBLE AS pa, 0.2::DOUBLE AS pb, key % 10 / 10.0::DOUBLE AS pc, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM q),
s AS (SELECT key, i, id, 1 / 3.0::DOUBLE AS a, 1 / 3.0::DOUBLE AS b, 1 / 3.0::DOUBLE AS c FROM r WHERE i = 1
  UNION ALL SELECT key, i, id, CASE WHEN a <= 0.03 THEN 0.03 ELSE a / free * rest END, CASE WHEN b <= 0.03 THEN 0.03 ELSE b / free * rest END, CASE WHEN c <= 0.03 THEN 0.03 ELSE c / free * rest END
  FROM (SELECT *, 1 - 0.03 * ((a <= 0.03)::INT + (b <= 0.03)::INT + (c <= 0.03)::INT) AS rest, CASE WHEN a <= 0.03 THEN 0 ELSE a END + CASE WHEN b <= 0.03 THEN 0 ELSE b END + CASE WHEN c <= 0.03 THEN 0 ELSE c END AS free
    FROM (SELECT key, i, id, x / (x + y + z) AS a, y / (x + y + z) AS b, z / (x + y + z) AS c
      FROM (SELECT n.key, n.i, n.id, s.a * exp(-0.6 * (r.pa - r.y) ** 2) AS x, s.b * exp(-0.6 * (r.pb - r.y) ** 2) AS y, s.c * exp(-0.6 * (r.pc - r.y) ** 2) AS z
        FROM s JOIN r ON r.key = s.key AND r.i = s.i JOIN r n ON n.key = s.key AND n.i = s.i + 1))))
SELECT key, id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM s
""")
def q_hedge_weights(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).select("key", "ts_us", "id", (F.col("kind") == "view").cast("double").alias("y"), ((1 + F.col("id") % 97) / 99.0).alias("a"), F.lit(0.2).alias("b"), (F.col("key") % 10 / 10.0).alias("c"))
    w = folds.hedged(q, ["a", "b", "c"])
    return w.select("key", "id", *[F.round(c, 6).alias(c) for c in "abc"])


@query(f"""
WITH RECURSIVE {Q}, r AS (SELECT key, id, ts_us, floor(price / 50)::DOUBLE AS value, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM q),
s AS (SELECT key, i, id, ts_us, value, true AS kept, ts_us AS last, value AS v FROM r WHERE i = 1
  UNION ALL SELECT key, i, id, ts_us, value, kept, CASE WHEN kept THEN ts_us ELSE last END, CASE WHEN kept THEN value ELSE v END
  FROM (SELECT r.*, abs(r.value - s.v) > 0 OR r.ts_us - s.last >= 21600000000 AS kept, s.last, s.v FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1))
SELECT key, id, ts_us, value FROM s WHERE kept
""")
def q_change_log(spark: SparkSession, sf: str) -> DataFrame:
    return folds.change_log(quotes(spark, sf).select("key", "id", "ts_us", F.floor(F.col("price") / 50).cast("double").alias("value")), 3_600_000_000 * 6)


@query(f"""
WITH {Q}, s AS (SELECT id, last_value(CASE WHEN kind = 'view' THEN price END IGNORE NULLS) OVER w AS back, last_value(CASE WHEN kind = 'click' THEN price END IGNORE NULLS) OVER w AS lay, max((kind = 'purchase')::INT) OVER w AS closing
  FROM q WINDOW w AS (PARTITION BY key ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, back, lay, closing::INT AS closing FROM s WHERE back IS NOT NULL AND lay IS NOT NULL
""")
def q_merged_state(spark: SparkSession, sf: str) -> DataFrame:
    kind, price = F.col("kind"), F.col("price")
    state = {"back": F.when(kind == "view", price), "lay": F.when(kind == "click", price), "played": F.when(kind == "purchase", 1)}
    s = joins.carried(quotes(spark, sf), ["key"], F.floor(F.col("ts_us") / DAY), ["ts_us", "id"], state)
    return s.where("back is not null and lay is not null").select("id", "back", "lay", F.coalesce("played", F.lit(0)).alias("closing"))


@query(f"""
WITH RECURSIVE {Q}, r AS (SELECT key, id, kind, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM q),
s AS (SELECT key, i, id, sha256(key || ':' || id || ':' || kind || ':') AS link FROM r WHERE i = 1
  UNION ALL SELECT r.key, r.i, r.id, sha256(r.key || ':' || r.id || ':' || r.kind || ':' || s.link) FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1)
SELECT key, id, link FROM s
""")
def q_chain_links(spark: SparkSession, sf: str) -> DataFrame:
    return folds.chained(quotes(spark, sf).withColumnRenamed("kind", "content"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0),
r AS (SELECT 7::BIGINT AS node, 0 AS depth UNION ALL SELECT e.child, depth + 1 FROM r JOIN e ON e.parent = r.node WHERE depth < 4) SELECT node, depth::INT AS depth FROM r
""")
def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    level = spark.range(7, 8).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, 5):  # as many joins as levels asked for; the plan stays lazy
        level = level.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(depth).alias("depth"))
        out = out.unionAll(level)
    return out


@query(f"""
WITH {O}, m AS (SELECT avg(price) AS mean FROM o) SELECT key, count(*) AS n, round(CASE WHEN count(*) >= 12 THEN exp(sum(ln(price / mean)) / (count(*) + 25)) ELSE 1 END, 6) AS factor FROM o, m GROUP BY key
""")
def q_judge_factor(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    mean = o.agg(F.avg("price").alias("mean"))  # one row
    r = o.join(F.broadcast(mean)).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.log(F.col("price") / F.col("mean"))).alias("s"))
    return r.select("key", "n", F.round(F.when(F.col("n") >= 12, F.exp(F.col("s") / (F.col("n") + 25))).otherwise(1.0), 6).alias("factor"))
