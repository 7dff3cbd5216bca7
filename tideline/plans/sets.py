"""Unions, overlays, differences, orderings, top rows and nested groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from .joins import Q, quotes
from .scalars import DRAW_SQL, draws


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS phone FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'none' FROM supplier")
def q_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("none").alias("phone"))
    return c.unionByName(s, allowMissingColumns=True)


@query(f"WITH {Q}, u AS (SELECT *, 0 AS arrival FROM q UNION ALL SELECT id, key, kind, ts_us, price + 1, 1 FROM q WHERE kind = 'view' OR price > 40) SELECT id, arg_max(price, arrival) AS price FROM u GROUP BY 1")
def q_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).withColumn("arrival", F.lit(0))
    u = q.unionByName(q.where("kind = 'view' or price > 40").withColumns({"price": F.col("price") + 1, "arrival": F.lit(1)}))
    return u.groupBy("id").agg(F.max_by("price", "arrival").alias("price"))


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def q_overlay(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    a, b = c.where("c_acctbal > 0").select(k.alias("k"), F.col("c_acctbal").alias("a")), c.where("c_mktsegment <> 'BUILDING'").select(k.alias("k"), (F.col("c_acctbal") * 2).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("b", "a").alias("v"))


@query(f"""WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)})
SELECT a.draw_id, len(list_intersect(a.numbers, b.numbers))::INT AS matches, len(list_filter(a.numbers, lambda x: NOT list_contains(b.numbers, x)))::INT AS missed, a.numbers = b.numbers AS same FROM d a JOIN d b ON b.draw_id = a.draw_id + 1""")
def q_number_matches(spark: SparkSession, sf: str) -> DataFrame:
    d = draws(spark, sf)
    b = d.select((F.col("draw_id") - 1).alias("draw_id"), F.col("numbers").alias("next"))
    return d.join(b, "draw_id").select("draw_id", F.size(F.array_intersect("numbers", "next")).alias("matches"), F.size(F.array_except("numbers", "next")).alias("missed"), (F.col("numbers") == F.col("next")).alias("same"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def q_without_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_common_nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query(f"""WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), f AS (SELECT n, count(*) AS times FROM (SELECT unnest(numbers) AS n FROM d) GROUP BY 1)
SELECT 'hot' AS side, n, times FROM (SELECT * FROM f ORDER BY times DESC, n LIMIT 6) UNION ALL SELECT 'cold', n, times FROM (SELECT * FROM f ORDER BY times, n LIMIT 6)""")
def q_hot_and_cold(spark: SparkSession, sf: str) -> DataFrame:
    f = draws(spark, sf).select(F.explode("numbers").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    hot, cold = f.orderBy(F.desc("times"), "n").limit(6), f.orderBy("times", "n").limit(6)
    return hot.select(F.lit("hot").alias("side"), "n", "times").unionAll(cold.select(F.lit("cold").alias("side"), "n", "times"))


@query(f"WITH {Q}, m AS (SELECT max(ts_us) AS m FROM q) SELECT id, key FROM q, m WHERE ts_us >= m - 5 * 86400000000")
def q_recent_days(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    newest = q.agg(F.max("ts_us").alias("m"))  # one row
    return q.join(F.broadcast(newest), F.col("ts_us") >= F.col("m") - 5 * 86_400_000_000).select("id", "key")


@query(f"""WITH {Q}, t AS (SELECT key, kind, string_agg(id::VARCHAR, ',' ORDER BY ts_us, id) AS ids FROM q GROUP BY 1, 2) SELECT key, string_agg(kind || ':' || ids, ';' ORDER BY kind) AS line FROM t GROUP BY 1""")
def q_nested_timelines(spark: SparkSession, sf: str) -> DataFrame:
    inner = quotes(spark, sf).groupBy("key", "kind").agg(F.array_sort(F.collect_list(F.struct("ts_us", "id"))).alias("line"))
    ids = F.array_join(F.transform("line", lambda x: x["id"].cast("string")), ",")
    outer = inner.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", ids.alias("ids")))).alias("t"))
    return outer.select("key", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["kind"], x["ids"])), ";").alias("line"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey FROM r WHERE n <= 2""")
def q_retained(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf, "supplier").withColumn("n", F.row_number().over(w)).where("n <= 2").select("s_nationkey", "s_suppkey")
