"""Payloads to rows, and merges of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import readers, writers
from .joins import Q, quotes


@query("""SELECT l_orderkey::VARCHAR AS id, CASE l_linenumber % 3 WHEN 0 THEN 'CHL' ELSE 'HAD' END AS type, l_linenumber::VARCHAR AS line, side, CASE WHEN side = 'H' THEN l_quantity ELSE l_tax * 100 END AS odds
FROM lineitem CROSS JOIN (SELECT unnest(['H', 'L']) AS side) WHERE l_linenumber % 3 < 2 AND CASE WHEN side = 'H' THEN l_quantity ELSE l_tax * 100 END > 0""")
def q_flat_quotes(spark: SparkSession, sf: str) -> DataFrame:
    combo = lambda side, odds: F.struct(F.lit(side).alias("side"), odds.cast("string").alias("odds"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "CHL").when(F.col("l_linenumber") % 3 == 1, "HAD").otherwise("HIL")
    line = F.struct(F.col("l_linenumber").cast("string").alias("line"), F.lit("AVAILABLE").alias("status"), F.array(combo("H", F.col("l_quantity")), combo("L", F.col("l_tax") * 100)).alias("combos"))
    match = F.struct(F.col("l_orderkey").cast("string").alias("id"), F.array(F.struct(kind.alias("type"), F.array(line).alias("lines"))).alias("pools"))
    payload = table(spark, sf, "lineitem").select(F.to_json(F.array(match)).alias("payload"))
    return readers.flat_quotes(payload).drop("status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def q_any_date(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), readers.any_date(text).alias("day"))


@query("""SELECT o_orderkey::VARCHAR AS label, CASE o_orderkey % 4 WHEN 1 THEN 'out of range' WHEN 2 THEN 'repeated number' WHEN 3 THEN 'not a number' END AS error FROM orders""")
def q_draw_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    last = F.when(k % 4 == 1, "50").when(k % 4 == 2, "5").when(k % 4 == 3, "x").otherwise("6")
    lines = table(spark, sf, "orders").select(F.concat_ws(",", k, *[F.lit(str(i)) for i in (1, 2, 3, 4, 5)], last).alias("value"))
    return readers.draw_lines(lines).select("label", "error")


@query("""SELECT o_orderkey AS id, unnest(range(0, 3))::INT AS hour, unnest([o_totalprice, o_totalprice / 2, o_totalprice * 2]) AS value FROM orders""")
def q_zipped_hours(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("hour"), F.array(p, p / 2, p * 2).alias("value"))
    return rows.select("id", F.inline(F.arrays_zip("hour", "value")))


@query("""SELECT c_custkey AS id, c_name AS name, c_nationkey::INT AS nation, c_acctbal AS balance FROM customer""")
def q_positional_rows(spark: SparkSession, sf: str) -> DataFrame:
    packed = table(spark, sf, "customer").select(F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string")).alias("v"))
    ts_us = lambda i: F.get("v", F.lit(i))
    return packed.select(ts_us(0).cast("long").alias("id"), ts_us(1).alias("name"), ts_us(2).cast("int").alias("nation"), ts_us(3).cast("double").alias("balance"))


@query(f"WITH {Q} SELECT id, key, ts_us, price FROM q UNION ALL SELECT -id, key, ts_us, price FROM q WHERE id % 3 = 0 AND id > 0")
def q_immutable_merge(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).select("id", "key", "ts_us", "price")
    fresh = q.withColumn("id", F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")))  # a third is new to the store
    return writers.merged(q, fresh, ["id"])


@query(f"WITH {Q}, u AS (SELECT key, ts_us, price, 1 AS old FROM q UNION ALL SELECT key, ts_us + key % 3 - 1, -price, 0 FROM q) SELECT key, max(ts_us) AS ts_us, arg_max(price, ts_us * 2 + old) AS price FROM u GROUP BY 1")
def q_newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).select("key", "ts_us", "price")
    later = q.select("key", (F.col("ts_us") + F.col("key") % 3 - 1).alias("ts_us"), (-F.col("price")).alias("price"))  # earlier, as old or newer, by key
    return writers.newest(q, later, ["key"], "ts_us").select(*q.columns)


@query("""WITH d AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS day) SELECT day FROM d UNION SELECT o_orderdate::DATE FROM orders""")
def q_candidate_days(spark: SparkSession, sf: str) -> DataFrame:
    every = spark.range(1).select(F.explode(F.sequence(F.lit("1999-01-01").cast("date"), F.lit("1999-12-31").cast("date"))).alias("day"))
    return every.union(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date"))).distinct()
