"""Feeds as they arrive (JSON payloads, change streams, text files) read into typed rows; what a store keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import exchange, matches, readers, store, writers
from ..streaming import quotes as S
from .joins import Q, quotes

NOW = "1995-06-01T12:00:00"


@query("""
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'CHL' WHEN 1 THEN 'HAD' ELSE 'HIL' END AS kind, l_quantity - 1 AS high, l_tax * 100 AS low, l_orderkey % 4 AS t, (l_orderkey % 90) - 10 AS h FROM lineitem)
SELECT 'football:' || id || ':' || kind || ':' || n AS key, kind AS market, CASE t WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS league, id::VARCHAR AS match_id, n::VARCHAR AS condition,
  CASE WHEN high > 0 THEN high END AS high, CASE WHEN low > 0 THEN low END AS low, h * 60 AS minutes FROM l WHERE kind <> 'HIL' AND t < 3 AND h BETWEEN -4 AND 60 AND (high > 0 OR low > 0)
""")
def q_football_quotes(spark: SparkSession, sf: str) -> DataFrame:
    n, h = F.col("l_linenumber"), F.col("l_orderkey") % 90 - 10
    combo = lambda side, odds: F.struct(F.lit(side if side == "H" else "").alias("str"), odds.cast("string").alias("currentOdds"), F.array(F.struct(F.lit(side).alias("str"))).alias("selections"))
    kind = F.when(n % 3 == 0, "CHL").when(n % 3 == 1, "HAD").otherwise("HIL")
    line = F.struct(n.cast("string").alias("condition"), F.lit("AVAILABLE").alias("status"), F.array(combo("H", F.col("l_quantity") - 1), combo("L", F.col("l_tax") * 100)).alias("combinations"))
    starts = F.date_format(F.to_timestamp(F.lit(NOW)) + F.make_interval(hours=h.cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    match = F.struct(F.col("l_orderkey").cast("string").alias("id"), starts.alias("kickOffTime"), F.struct((F.col("l_orderkey") % 4).cast("string").alias("nameProfileId")).alias("tournament"), F.array(F.struct(kind.alias("oddsType"), F.array(line).alias("lines"))).alias("foPools"))
    payloads = table(spark, sf, "lineitem").select(F.to_json(F.struct(F.struct(F.array(match).alias("matches")).alias("data"))).alias("payload"))
    q = exchange.football_quotes(payloads, {"0": "one", "1": "two", "2": "three"}, F.to_timestamp(F.lit(NOW)))
    price = lambda side: F.try_element_at("odds", F.lit(side))
    return q.select("key", "market", "league", "match_id", "condition", price("H").alias("high"), price("L").alias("low"), "minutes")


@query("""
WITH l AS (SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'WIN' WHEN 1 THEN 'PLA' ELSE 'QIN' END AS kind, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity) AS name, l_quantity - 1 AS odds FROM lineitem)
SELECT 'racing:1995-01-01:ST:' || l_orderkey || ':' || kind AS key, kind AS market, 'HK:1995-01-01:ST:' || l_orderkey AS race_id, count(DISTINCT name) AS runners, min(odds) AS lowest
FROM l WHERE kind <> 'QIN' AND odds > 0 AND l_orderkey % 5 > 0 GROUP BY ALL
""")
def q_racing_quotes(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("l_orderkey")
    node = F.struct(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("combString"), (F.col("l_quantity") - 1).cast("string").alias("oddsValue"))
    races = table(spark, sf, "lineitem").groupBy(o).agg(F.collect_list(node).alias("nodes"))  # a race's runners
    kind = F.when(o % 3 == 0, "WIN").when(o % 3 == 1, "PLA").otherwise("QIN")
    leg = F.struct(F.when(o % 5 > 0, F.array(o.cast("int"))).otherwise(F.array().cast("array<int>")).alias("races"))
    pool = F.struct(kind.alias("oddsType"), leg.alias("leg"), F.col("nodes").alias("oddsNodes"))
    meeting = F.struct(F.lit("1995-01-01").alias("date"), F.lit("ST").alias("venueCode"))
    q = exchange.racing_quotes(races.select(F.to_json(F.struct(meeting.alias("meeting"), F.array(pool).alias("pools"))).alias("payload")))
    return q.select("key", "market", "race_id", F.size("odds").cast("long").alias("runners"), F.array_min(F.map_values("odds")).alias("lowest"))


@query(f"""
WITH {Q}, e AS (SELECT key, id, ts_us // 1000 AS pt, kind, 1 + price AS price, row_number() OVER (PARTITION BY key ORDER BY ts_us // 1000, id) AS i FROM q),
f AS (SELECT *, max(CASE WHEN kind = 'view' THEN i END) OVER w AS ov, max(CASE WHEN kind = 'click' THEN i END) OVER w AS un, max(CASE WHEN kind = 'error' THEN i END) OVER w AS played, min(i) OVER w AS first FROM e WINDOW w AS (PARTITION BY key ORDER BY i)),
s AS (SELECT f.key, f.pt, f.i, o.price AS over_odds, u.price AS under_odds, 8.5 + f.key % 3 AS line FROM f JOIN e o ON o.key = f.key AND o.i = f.ov JOIN e u ON u.key = f.key AND u.i = f.un WHERE played IS NULL AND o.price > 1 AND u.price > 1),
d AS (SELECT key, pt, line, arg_max(over_odds, i) AS over_odds, arg_max(under_odds, i) AS under_odds FROM s GROUP BY ALL), p AS (SELECT DISTINCT key FROM e WHERE kind = 'error')
SELECT key::VARCHAR AS market_id, pt, line::DOUBLE AS line, over_odds, under_odds, p.key IS NOT NULL AND pt = max(pt) OVER (PARTITION BY d.key, line) AS is_closing FROM d LEFT JOIN p USING (key)
""")
def q_exchange_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a change of its user's market: views and clicks are prices, an error sends the market in play."""
    from pyspark.sql import Window

    q = quotes(spark, sf)
    pt = F.floor(F.col("ts_us") / 1000).cast("long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(pt, "id"))
    e = q.select("key", "id", pt.alias("pt"), "kind", (1 + F.col("price")).alias("price"), place.alias("i"))
    runner = lambda i, name: F.struct(F.lit(i).alias("id"), name.alias("name"))
    line = (F.col("key") % 3 + 8.5).cast("string")
    definition = F.struct(F.concat(F.lit("A v B "), F.col("key")).alias("eventName"), F.concat(F.lit("Corners O/U "), line).alias("name"), F.lit("2100-01-01T00:00:00Z").alias("marketTime"), (F.col("kind") == "error").alias("inPlay"), F.array(runner(1, F.concat(F.lit("Over "), line)), runner(2, F.concat(F.lit("Under "), line))).alias("runners"))
    price = lambda i: F.array(F.struct(F.lit(i).alias("id"), F.col("price").alias("ltp")))
    prices = F.when(F.col("kind") == "view", price(1)).when(F.col("kind") == "click", price(2))
    told = F.when((F.col("i") == 1) | (F.col("kind") == "error"), definition)
    message = F.to_json(F.struct("pt", F.array(F.struct(F.col("key").cast("string").alias("id"), told.alias("marketDefinition"), prices.alias("rc"))).alias("mc")))
    lines = e.select(F.struct("pt", "id").alias("seq"), message.alias("value"))
    s = exchange.snapshots(lines)
    return s.select("market_id", F.unix_millis("captured_at").alias("pt"), "line", "over_odds", "under_odds", "is_closing")


FILE_SQL = """
WITH f AS (SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'E0' WHEN 1 THEN 'E1' ELSE 'SP1' END AS div, CASE WHEN o_orderkey % 19 > 0 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 23 > 0 THEN 'T' || o_custkey % 20 END AS home,
  CASE WHEN o_orderkey % 29 > 0 THEN (o_orderkey % 14)::DOUBLE END AS hc, (o_orderkey % 9)::DOUBLE AS ac, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 100000 END AS avg_h FROM orders)
"""


def match_file(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a row of a match file: all text, dates of two kinds, blanks and words where numbers should be."""
    k, i, d = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(i % 19 == 0, "soon").when(i % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd/MM/yy"))
    return table(spark, sf, "orders").select(
        i.cast("string").alias("id"), F.when(k % 4 == 0, "E0").when(k % 4 == 1, "E1").otherwise("SP1").alias("Div"), date.alias("Date"), F.when(i % 23 > 0, F.concat(F.lit("T"), k % 20)).alias("HomeTeam"), F.lit("Away").alias("AwayTeam"),
        F.when(i % 29 > 0, (i % 14).cast("string")).otherwise("").alias("HC"), (i % 9).cast("string").alias("AC"), F.when(i % 7 > 0, (F.col("o_totalprice") / 100000).cast("string")).otherwise("n/a").alias("AvgH"), F.lit("2.5").alias("Avg>2.5"),
    )


@query(f"{FILE_SQL} SELECT id::VARCHAR AS id, div AS division, day, home, hc::INT AS hc, ac::INT AS ac, avg_h, 2.5::DOUBLE AS over_25, '2425' AS season FROM f WHERE div IN ('E0', 'E1') AND day IS NOT NULL AND home IS NOT NULL AND hc IS NOT NULL")
def q_normalised_matches(spark: SparkSession, sf: str) -> DataFrame:
    m = matches.normalised_matches(match_file(spark, sf), "2425", ["E0", "E1"])
    return m.select("id", F.col("Division").alias("division"), F.col("Date").alias("day"), F.col("HomeTeam").alias("home"), F.col("HC").alias("hc"), F.col("AC").alias("ac"), F.col("AvgH").alias("avg_h"), F.col("`Avg>2.5`").alias("over_25"), F.col("Season").alias("season"))


@query(f"""{FILE_SQL} SELECT id::VARCHAR AS id, '20' || (20 + id % 3) || '/' || (21 + id % 3) AS season, div AS division, day, home, hc::INT AS hc, CASE WHEN div <> 'SP1' THEN avg_h END AS avg_h, CASE WHEN div <> 'E1' THEN 2.5::DOUBLE END AS over_25
FROM f WHERE day IS NOT NULL AND home IS NOT NULL AND hc IS NOT NULL""")
def q_season_files(spark: SparkSession, sf: str) -> DataFrame:
    """The rows as files of three divisions and seasons, each division with columns in an order of its own."""
    layouts = {"E0": ["id", "Div", "Date", "HomeTeam", "AwayTeam", "HC", "AC", "Avg>2.5", "AvgH"], "E1": ["Date", "AvgH", "HC", "AC", "AwayTeam", "HomeTeam", "Div", "id"], "SP1": ["Div", "Date", "HomeTeam", "HC", "AwayTeam", "HC", "id", "AC", "Avg>2.5"]}
    rows = match_file(spark, sf)
    n = F.col("id").cast("long")
    blank = F.when(n % 13 == 0, F.array(F.lit(", ,,"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"'))
    text = F.lit(None)
    for division, names in layouts.items():
        text = F.when(F.col("Div") == division, F.concat_ws(",", *[quoted(c) for c in names], F.lit("beyond"))).otherwise(text)
    lines = rows.select(F.concat("Div", F.lit("_2"), n % 3, F.lit("2"), n % 3 + 1, F.lit(".csv")).alias("file"), n.alias("at"), F.explode(F.concat(F.array(text), blank)).alias("value"))
    heads = [(f"{d}_2{s}2{s + 1}.csv", -1, "\ufeff" + ",".join(f'"{c}"' for c in names)) for d, names in layouts.items() for s in range(3)]
    lines = lines.unionAll(spark.createDataFrame([*heads, ("notes.csv", 0, "Div,HC"), ("notes.csv", 1, "E0,4")], "file string, at long, value string"))
    m = matches.seasons(readers.season_files(lines), ["E0", "SP1"], ["E1"])
    return m.select("id", F.col("Season").alias("season"), F.col("Division").alias("division"), F.col("Date").alias("day"), F.col("HomeTeam").alias("home"), F.col("HC").alias("hc"), F.col("AvgH").alias("avg_h"), F.col("`Avg>2.5`").alias("over_25"))


@query(f"{FILE_SQL} SELECT div, count(*) AS n, count(avg_h) AS priced, min(day) AS first FROM f WHERE div IN ('E0', 'SP1') AND day IS NOT NULL AND home IS NOT NULL GROUP BY 1")
def q_normalised_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    f = matches.normalised_fixtures(match_file(spark, sf), ["E0", "SP1"])
    return f.groupBy(F.col("Div").alias("div")).agg(F.count("*").alias("n"), F.count("AvgH").alias("priced"), F.min("Date").alias("first"))


@query("SELECT c_custkey AS squad, c_acctbal AS matches FROM customer")
def q_renamed_by_part(spark: SparkSession, sf: str) -> DataFrame:
    return matches.renamed_by_part(table(spark, sf, "customer"), {"custkey": "squad", "acctbal": "matches"})


@query(f"WITH {Q}, h AS (SELECT date_trunc('hour', make_timestamp(ts_us)) AS start, kind, price FROM q) SELECT start, kind, count(*) AS n, round(avg(price), 6) AS mean FROM h GROUP BY 1, 2")
def q_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    return S.windowed_counts(q, "ts").withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {Q} SELECT id FROM q WHERE ts_us BETWEEN 0 AND 0 OR (key % 100 - 4) * 3600000000 BETWEEN -60 * 3600000000 AND 4 * 3600000000")
def q_admitted(spark: SparkSession, sf: str) -> DataFrame:
    return S.admitted(quotes(spark, sf), F.col("ts_us"), F.col("ts_us") - (F.col("key") % 100 - 4) * 3_600_000_000).select("id")


@query(f"""
WITH {Q}, r AS (SELECT key, ts_us, id, kind = 'purchase' AS rec FROM q),
g AS (SELECT key, arg_min(rec, (ts_us, id)) AS first, arg_min(id, (ts_us, id)) AS a, arg_min(id, (ts_us, id)) FILTER (WHERE rec) AS b FROM r GROUP BY 1)
SELECT key, CASE WHEN first OR b IS NULL THEN a ELSE b END AS id, first OR b IS NOT NULL AS rec FROM g
""")
def q_upgraded_once(spark: SparkSession, sf: str) -> DataFrame:
    r = quotes(spark, sf).select("key", "ts_us", "id", (F.col("kind") == "purchase").alias("rec"))
    return S.upgraded(r, "key", "ts_us", "rec").select("key", "id", "rec")


@query(f"WITH {Q} SELECT key, kind, count(*) AS n FROM (SELECT DISTINCT key, kind, floor(price / 50) AS p FROM q) GROUP BY 1, 2")
def q_archived(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).select("key", "kind", F.floor(F.col("price") / 50).alias("p"))
    return S.archived(q, ["key", "kind", "p"]).groupBy("key", "kind").agg(F.count("*").alias("n"))


@query("""SELECT substr(sha256('{"id":' || s_suppkey || ',"name":"' || s_name || '"}'), 1, 20) AS version, '{"id":' || s_suppkey || ',"name":"' || s_name || '"}' AS payload FROM supplier""")
def q_versioned(spark: SparkSession, sf: str) -> DataFrame:
    return writers.versioned(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(f"""
{FILE_SQL}, r AS (SELECT div, id, day, '["' || day || '",' || CASE WHEN home IS NULL THEN 'null' ELSE '"' || home || '"' END || ',' || coalesce(hc::BIGINT::VARCHAR, 'null') || ',' || ac::BIGINT || ',' || coalesce(round(avg_h * 100, 5)::VARCHAR, 'null') || ']' AS line FROM f WHERE day IS NOT NULL),
g AS (SELECT div AS division, count(*) AS n, max(day) AS trained_through, '[' || string_agg(line, ',' ORDER BY day, id) || ']' AS payload FROM r GROUP BY 1)
SELECT division, n, trained_through, length(payload)::INT AS size, substr(sha256(payload), 1, 16) AS version FROM g
""")
def q_seed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of each division as a compact seed: whole numbers whole, decimals to five places."""
    o = table(spark, sf, "orders")
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(F.when(k % 4 == 0, "E0").when(k % 4 == 1, "E1").otherwise("SP1").alias("division"), i.alias("id"), F.when(i % 19 > 0, F.col("o_orderdate").cast("date")).alias("day"), F.when(i % 23 > 0, F.concat(F.lit("T"), k % 20)).alias("home"), F.when(i % 29 > 0, i % 14).alias("hc"), (i % 9).alias("ac"), F.when(i % 7 > 0, F.col("o_totalprice") / 1000).alias("avg_h")).where("day is not null")
    through = rows.groupBy("division").agg(F.max("day").alias("trained_through"))
    return store.seeds(rows, ["division"], ["day", "id"], ["day", "home", "hc", "ac", "avg_h"]).join(through, "division").select("division", "n", "trained_through", F.length("payload").alias("size"), "version")
