"""Decision rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import windows as W
from ..registry import query, table
from .joins import O, Q, orders, quotes
from .windows import LINES, runners

C = f"""{O}, c AS (SELECT id, (id % 101) / 100.0::DOUBLE AS p, (id % 17)::DOUBLE AS width, (key % 40) / 10.0::DOUBLE AS games, (id % 5 = 0)::INT AS promoted, (key % 11) / 10.0::DOUBLE AS support, (key % 9) / 100.0::DOUBLE AS ece, (id % 7 - 1)::DOUBLE AS mae, (id % 6 - 1)::DOUBLE AS brier FROM o),
e AS (SELECT *, abs(p - 0.5) AS edge, mae < 0 OR brier < 0 AS worse, (0.45 * greatest(0.2, least(1, 1 - greatest(width - 7, 0) / 10)) + 0.35 * greatest(0.15, least(1, 1 - ece / 0.08)) + 0.2 * greatest(0.15, least(1, (games - 1) / 2.5))) * CASE WHEN mae < 0 OR brier < 0 THEN 0.65 ELSE 1 END AS stable FROM c),
s AS (SELECT *, 0.42 * greatest(0.4, least(1, 1 - 0.45 * support)) + 0.38 * stable + 0.2 * greatest(0.1, least(1, edge / 0.16)) AS raw FROM e),
t AS (SELECT *, least(raw, CASE WHEN promoted > 0 THEN 0.58 ELSE 2 END, CASE WHEN worse THEN 0.5 ELSE 2 END) AS score FROM s)"""


@query(f"""
WITH {C} SELECT id, round(score, 6) AS score, CASE WHEN edge < 0.06 OR score < 0.52 THEN 'avoid' WHEN score >= 0.78 AND edge >= 0.14 THEN 'high' WHEN score >= 0.63 AND edge >= 0.09 THEN 'medium' ELSE 'low' END AS label FROM t
""")
def q_football_confidence(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("id"), F.col("key")
    score, label = R.football_confidence(i % 101 / 100.0, (i % 17).cast("double"), k % 40 / 10.0, (i % 5 == 0).cast("int"), k % 11 / 10.0, k % 9 / 100.0, (i % 7 - 1).cast("double"), (i % 6 - 1).cast("double"))
    return orders(spark, sf).select("id", F.round(score, 6).alias("score"), label.alias("label"))


@query(f"""
WITH {O}, c AS (SELECT id, (id % 61) / 60.0::DOUBLE AS p, (key % 35) / 10.0::DOUBLE AS starts, (id % 9 - 2)::DOUBLE AS skill, id % 14 AS field, key % 4 = 0 AS baseline FROM o),
s AS (SELECT *, 0.45 * least(greatest(p - 1 / greatest(field, 1)::DOUBLE, 0) / 0.16, 1) + 0.3 * least(starts / ln(21), 1) + 0.25 * CASE WHEN baseline THEN 0.62 WHEN skill > 0 THEN 0.75 ELSE 0.42 END AS raw FROM c),
t AS (SELECT *, CASE WHEN skill <= 0 AND NOT baseline THEN least(raw, 0.52) ELSE raw END AS score FROM s)
SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.76 THEN 'high' WHEN score >= 0.62 THEN 'medium' WHEN score >= 0.46 THEN 'low' ELSE 'avoid' END AS label FROM t
""")
def q_racing_confidence(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("id"), F.col("key")
    score, label = R.racing_confidence(i % 61 / 60.0, k % 35 / 10.0, (i % 9 - 2).cast("double"), i % 14, k % 4 == 0)
    return orders(spark, sf).select("id", F.round(score, 6).alias("score"), label.alias("label"))


@query(f"""
WITH {Q} SELECT id, CASE WHEN kind = 'error' THEN 'void' WHEN id % 13 = 0 THEN 'data error' WHEN key % 17 = 0 THEN 'model drift' WHEN abs((id % 50 - 25) / 100.0::DOUBLE) >= 0.18 THEN 'market move' ELSE 'healthy' END AS event FROM q
""")
def q_event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return quotes(spark, sf).select("id", R.event_kind(i % 13 == 0, F.col("kind") == "error", (i % 50 - 25) / 100.0, F.col("key") % 17 == 0).alias("event"))


@query("""
WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Good' WHEN 2 THEN 'good to yielding' WHEN 3 THEN 'Wet Slow' ELSE 'Firm' END AS going, p_partkey % 3 > 0 AS known, (p_partkey % 7) / 4.0::DOUBLE AS rain, (80 + p_partkey % 20) / 100.0::DOUBLE AS humid, p_size % 15 AS field, 1000 + 200 * (p_partkey % 7) AS metres, p_size % 15 - 1 AS draw FROM part),
w AS (SELECT *, regexp_matches(upper(going), 'WET|SOFT|YIELDING|SLOW') OR (known AND rain >= 1) AS wet FROM c)
SELECT id, wet, round(least(1, CASE WHEN wet THEN 0.45 ELSE 0 END + CASE WHEN going = '' THEN 0.15 ELSE 0 END + CASE WHEN known THEN 0 ELSE 0.1 END + CASE WHEN field >= 12 THEN 0.2 WHEN field >= 10 THEN 0.1 ELSE 0 END + CASE WHEN known AND humid >= 0.9 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS uncertainty,
  round(CASE WHEN draw <= 0 OR field < 4 THEN 0 ELSE greatest(-0.12, least(0.12, -(CASE WHEN id % 2 = 0 THEN CASE WHEN metres <= 1800 THEN 0.24 ELSE 0.16 END ELSE CASE WHEN metres <= 1200 THEN 0.2 WHEN metres <= 1650 THEN 0.12 ELSE 0.06 END END) * ((draw - 1) / greatest(field - 1, 1)::DOUBLE - 0.5))) END, 6)::DOUBLE + 0.0 AS draw_bias FROM w
""")
def q_race_context(spark: SparkSession, sf: str) -> DataFrame:
    i, size = F.col("p_partkey"), F.col("p_size")
    going = F.when(i % 5 == 0, "").when(i % 5 == 1, "Good").when(i % 5 == 2, "good to yielding").when(i % 5 == 3, "Wet Slow").otherwise("Firm")
    known, rain, humid, field = i % 3 > 0, i % 7 / 4.0, (80 + i % 20) / 100.0, size % 15
    bias = R.draw_bias(F.when(i % 2 == 0, "hv").otherwise("ST"), 1000 + 200 * (i % 7), size % 15 - 1, field)
    return table(spark, sf, "part").select(i.alias("id"), R.wet(going, F.when(known, rain)).alias("wet"), F.round(R.race_uncertainty(going, rain, humid, field, known), 6).alias("uncertainty"), (F.round(bias, 6) + 0.0).alias("draw_bias"))


@query("""
WITH b AS (SELECT l_orderkey AS race, l_linenumber AS n, l_partkey % 9 AS a, l_suppkey % 9 AS c FROM lineitem),
x AS (SELECT *, CASE WHEN a + c < 3 THEN 0 ELSE (a - c) / (a + c)::DOUBLE END AS bias FROM b),
p AS (SELECT race, count(*) AS runners, count(*) FILTER (WHERE (bias > 0.34)) AS leaders FROM x GROUP BY 1)
SELECT race, runners, leaders, CASE WHEN runners < 4 THEN 'even' WHEN leaders / runners::DOUBLE >= 0.3 THEN 'fast' WHEN leaders / runners::DOUBLE <= 0.08 THEN 'slow' ELSE 'even' END AS pace FROM p
""")
def q_race_pace(spark: SparkSession, sf: str) -> DataFrame:
    # starts over 1000 m (band 5), 1400 m (7) and 1800 m (9), before a race of 1400 m
    starts = F.create_map(F.lit(5), F.col("l_partkey") % 9, F.lit(7), F.col("l_partkey"), F.lit(9), F.col("l_suppkey") % 9)
    bias = R.sprint_bias(starts, F.lit(1400))
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("race")).agg(F.count("*").alias("runners"), F.count(F.when(bias > 0.34, 1)).alias("leaders"))
    return p.select("race", "runners", "leaders", R.pace(F.col("leaders"), F.col("runners")).alias("pace"))


@query(f"""
WITH {LINES}, s AS (SELECT race, part, supp, line, q AS odds, count(*) OVER (PARTITION BY race) AS n, count(*) FILTER (WHERE (q > 1)) OVER (PARTITION BY race) AS quoted, sum(CASE WHEN q > 1 THEN 1 / q END) OVER (PARTITION BY race) AS total FROM l)
SELECT race, part, supp, line, round((1 / odds) / total, 6) AS p, quoted >= 3 AND quoted >= n - 1 AS whole FROM s WHERE odds > 1
""")
def q_pool_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("race")
    r = runners(spark, sf).withColumns({"n": F.count("*").over(w), "quoted": F.count(F.when(F.col("q") > 1, 1)).over(w)}).where("q > 1")
    return r.select("race", "part", "supp", "line", F.round(W.share(1 / F.col("q"), ["race"]), 6).alias("p"), ((F.col("quoted") >= 3) & (F.col("quoted") >= F.col("n") - 1)).alias("whole"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'man utd' WHEN 1 THEN 'wolves' WHEN 2 THEN 'brighton' ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) END AS team,
  CASE c_custkey % 3 WHEN 0 THEN 'm dean' WHEN 1 THEN 'a j o neill' ELSE trim(regexp_replace(lower(c_name), '[^a-z]+', ' ', 'g')) END AS referee,
  CASE WHEN c_custkey % 2 = 0 THEN 'Home ' || c_custkey END AS home, CASE WHEN c_custkey % 2 = 0 THEN 'Away v Others' END AS away, CASE WHEN c_custkey % 5 < 3 THEN 8.5 + c_custkey % 5 END::DOUBLE AS line, CASE WHEN c_custkey % 5 = 4 THEN NULL WHEN c_custkey % 5 = 3 THEN 'under' ELSE 'over' END AS side,
  CASE c_custkey % 3 WHEN 0 THEN '2024_A' || c_custkey WHEN 1 THEN 'H123' ELSE 'FAST_' || c_custkey END AS horse, 'E0:1995-03-0' || (1 + c_custkey % 9) || ':' || c_name || ':x' AS match_id FROM customer
""")
def q_names(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    pick = lambda by, *texts: F.get(F.array(*[t if not isinstance(t, str) else F.lit(t) for t in texts]), k % by)
    team = pick(4, "Manchester United", "Wolverhampton-Wanderers", "Brighton and Hove Albion", name)
    event = pick(2, F.concat(F.lit("Home "), k, F.lit(" v Away v Others")), "no event")
    market = F.concat(F.lit("Corners "), pick(5, *[F.lit(f"{i} and {8.5 + i}") for i in range(3)], "9", "none"), F.lit(" Corners"))
    runner = pick(5, "Over 8.5", "9 or more", "OVER", "8 or less", "Draw")
    link = F.when(k % 3 == 0, F.concat(F.lit("/horse?HorseId=HK_2024_A"), k, F.lit("&x=1")))
    horse = pick(3, "any", "Swift (H123)", F.concat(F.lit("Fast "), k))
    day = F.to_date(F.concat(F.lit("1995-03-0"), 1 + k % 9))
    teams = R.event_teams(event)
    return table(spark, sf, "customer").select(
        k.alias("id"), R.alias(team).alias("team"), R.referee(pick(3, "M. Dean", "A.J. O'Neill", name)).alias("referee"), F.when(F.size(teams) == 2, teams[0]).alias("home"), F.when(F.size(teams) == 2, teams[1]).alias("away"),
        R.corner_line(market).alias("line"), R.direction(runner).alias("side"), R.entity_id(link, horse).alias("horse"), R.match_id(F.lit("E0"), day, name, F.lit("x")).alias("match_id"),
    )


@query(f"""
WITH {O}, c AS (SELECT id, 3 + (id % 70) / 10.0::DOUBLE AS h1, 9 + (key % 30) / 10.0::DOUBLE AS t1, (1 + id % 9) / 100.0::DOUBLE AS v1, 4 + (key % 40) / 10.0::DOUBLE AS h2, 8 + (id % 50) / 10.0::DOUBLE AS t2, (1 + key % 7) / 100.0::DOUBLE AS v2 FROM o),
b0 AS (SELECT *, exp((ln(t1) / v1 + ln(t2) / v2) / (1 / v1 + 1 / v2)) AS t, CASE WHEN v1 <= v2 THEN h1 / t1 ELSE h2 / t2 END AS s FROM c), b AS (SELECT *, round(t, 9) AS r FROM b0)
SELECT id, round(t * s, 6) AS home, round(t * (1 - s), 6) AS away, round(1 / (1 / v1 + 1 / v2), 8) AS log_variance, greatest(ceil(r - 4.3::DOUBLE), 0)::BIGINT AS low, greatest(floor(r + 4.1::DOUBLE), greatest(ceil(r - 4.3::DOUBLE), 0) + 1)::BIGINT AS high FROM b
""")
def q_combined_priors(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("id"), F.col("key")
    home, away, v = R.combined_prior([3 + i % 70 / 10.0, 4 + k % 40 / 10.0], [9 + k % 30 / 10.0, 8 + i % 50 / 10.0], [(1 + i % 9) / 100.0, (1 + k % 7) / 100.0])
    b = orders(spark, sf).select("id", home.alias("home"), away.alias("away"), v.alias("v"))
    low, high = R.interval(F.round(F.col("home") + F.col("away"), 9), -4.3, 4.1)
    return b.select("id", F.round("home", 6).alias("home"), F.round("away", 6).alias("away"), F.round("v", 8).alias("log_variance"), low.alias("low"), high.alias("high"))


@query(f"""
WITH {O}, c AS (SELECT id, price * 100 AS pool, price * 20 AS units, (id % 40) / 20.0::DOUBLE AS crowd FROM o)
SELECT id, round(units / 13983816.0::DOUBLE * crowd, 8) AS winners, round(pool / (1 + units / 13983816.0::DOUBLE * crowd) / 13983816 - 10, 6) AS net, round((1 + units / 13983816.0::DOUBLE) / (1 + units / 13983816.0::DOUBLE * crowd), 6) AS ratio FROM c
""")
def q_parimutuel(spark: SparkSession, sf: str) -> DataFrame:
    others, net, ratio = R.parimutuel(F.col("price") * 100, F.col("price") * 20, F.col("id") % 40 / 20.0)
    return orders(spark, sf).select("id", F.round(others, 8).alias("winners"), F.round(net, 6).alias("net"), F.round(ratio, 6).alias("ratio"))


@query("""
WITH f AS (SELECT c_nationkey AS model, c_custkey % 5 AS fold, avg(abs(c_acctbal)) AS mae, avg(abs(c_acctbal - 500)) AS base_mae, avg(c_custkey % 10 / 10.0::DOUBLE) AS brier, avg(c_custkey % 9 / 9.0::DOUBLE) AS base_brier, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT model::BIGINT AS model, count(*) AS folds, count(*) FILTER (WHERE (mae < base_mae AND brier <= base_brier)) AS passed,
  count(*) >= 3 AND count(*) FILTER (WHERE (mae < base_mae AND brier <= base_brier)) * 2 > count(*) AND sum(mae * n) / sum(n) < sum(base_mae * n) / sum(n) AND sum(brier * n) / sum(n) <= sum(base_brier * n) / sum(n) AS released FROM f GROUP BY 1
""")
def q_release_gate(spark: SparkSession, sf: str) -> DataFrame:
    k, bal, mean = F.col("c_custkey"), F.col("c_acctbal"), lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    f = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("model"), (k % 5).alias("fold")).agg(
        F.avg(F.abs(bal)).alias("mae"), F.avg(F.abs(bal - 500)).alias("base_mae"), F.avg(k % 10 / 10.0).alias("brier"), F.avg(k % 9 / 9.0).alias("base_brier"), F.count("*").alias("n"))
    won = F.count(F.when(R.beats_baseline(*map(F.col, ("mae", "base_mae", "brier", "base_brier"))), 1))
    m = f.groupBy("model").agg(F.count("*").alias("folds"), won.alias("passed"), R.beats_baseline(*map(mean, ("mae", "base_mae", "brier", "base_brier"))).alias("beats"))
    return m.select("model", "folds", "passed", R.gate_passed(F.col("folds"), F.col("passed"), F.col("beats")).alias("released"))


@query("""
WITH c AS (SELECT p_partkey AS id, (p_size - 25) / 1000.0::DOUBLE AS mae, (p_partkey % 5 - 2) / 100.0::DOUBLE AS brier, range(0, p_partkey % 3) AS a, range(0, p_partkey % 4) AS b, range(0, p_size % 3) AS d FROM part)
SELECT id, CASE WHEN mae > 0.005 AND brier >= 0 THEN 'useful' WHEN mae < -0.005 THEN 'harmful' END AS signal, (len(a) + len(b) + 0.5 * len(d))::DOUBLE AS missing,
  round(CASE WHEN len(a) + len(b) + 0.5 * len(d) > 0 THEN least(0.02, 0.004 * (len(a) + len(b) + 0.5 * len(d))) ELSE 0 END, 6)::DOUBLE AS dispersion FROM c
""")
def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    of = lambda n: F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), n.cast("int"))
    missing = R.shortfall(of(k % 3), of(k % 4), of(size % 3))
    return table(spark, sf, "part").select(k.alias("id"), R.signal((size - 25) / 1000.0, (k % 5 - 2) / 100.0).alias("signal"), missing.alias("missing"), F.round(R.news_dispersion(missing), 6).alias("dispersion"))


@query(f"""
WITH {Q}, c AS (SELECT CASE WHEN id % 50 = 0 THEN '' ELSE (id - id % 2)::VARCHAR END AS code, id, key, ts_us, price, CASE WHEN id % 9 > 0 THEN (id % 12) / 10.0::DOUBLE END AS p, CASE WHEN id % 7 > 0 THEN (id % 11) / 10.0::DOUBLE END AS market, ts_us + (key % 10 - 2) * 60000000 AS kick_off FROM q),
v AS (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM c)
SELECT id, code <> '' AND price >= 0 AND ts_us < kick_off AND coalesce(p BETWEEN 0 AND 1, true) AND coalesce(market > 0 AND market < 1, true) AS valid, n > 1 AS repeated FROM v
""")
def q_shadow_records(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    q = quotes(spark, sf).withColumns({"code": F.when(i % 50 == 0, "").otherwise((i - i % 2).cast("string")), "kick_off": F.col("ts_us") + (F.col("key") % 10 - 2) * 60_000_000})
    n = q.groupBy("code").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    ok = R.shadow_valid(F.col("code"), F.col("price"), F.when(i % 9 > 0, i % 12 / 10.0), F.when(i % 7 > 0, i % 11 / 10.0), F.col("ts_us"), F.col("kick_off"), none, none)
    return q.join(n, "code").select("id", ok.alias("valid"), (F.col("n") > 1).alias("repeated"))


@query(f"""
WITH {Q}, n AS (SELECT * FROM (VALUES ('view', 'seen'), ('click', 'hit'), ('purchase', 'bought')) t(kind, name)) SELECT id, coalesce(name, kind) AS kind, coalesce(name, '') AS known FROM q LEFT JOIN n USING (kind)
""")
def q_translated(spark: SparkSession, sf: str) -> DataFrame:
    names = {"view": "seen", "click": "hit", "purchase": "bought"}
    return quotes(spark, sf).select("id", R.translated(F.col("kind"), names).alias("kind"), R.translated(F.col("kind"), names, F.lit("")).alias("known"))


@query(f"""
WITH {Q}, t AS (SELECT id, key AS match, ts_us AS made, price, ts_us + (id % 5 - 1) * 1000000 AS kick_off FROM q WHERE kind = 'purchase'),
e AS (SELECT match, arg_min(id, (made, id)) AS trade, arg_min(price, (made, id)) AS odds FROM t WHERE made < kick_off GROUP BY 1),
f AS (SELECT DISTINCT key AS match, key % 4 = 0 AS picked FROM q WHERE kind = 'view')
SELECT coalesce(f.match, e.match) AS match, CASE WHEN f.match IS NULL THEN 'appended' WHEN e.match IS NOT NULL AND NOT picked THEN 'bridged' ELSE 'kept' END AS action, CASE WHEN f.match IS NULL OR NOT picked THEN e.trade END AS trade, CASE WHEN f.match IS NULL OR NOT picked THEN e.odds END AS odds
FROM f FULL JOIN e ON f.match = e.match
""")
def q_bridged_trades(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.joins import bridged

    q = quotes(spark, sf)
    trades = q.where("kind = 'purchase'").select("id", F.col("key").alias("match"), F.col("ts_us").alias("made"), "price", (F.col("ts_us") + (F.col("id") % 5 - 1) * 1_000_000).alias("kick_off"))
    forecasts = q.where("kind = 'view'").select(F.col("key").alias("match"), (F.col("key") % 4 == 0).alias("picked")).distinct()
    early = trades.where("made < kick_off")
    return bridged(forecasts, early, "match", "picked", "made", {"trade": "id", "odds": "price"})


@query(f"""
WITH {Q}, r AS (SELECT id, ts_us AS kick_off, (id % 24 - 1) AS home, (id % 29 - 1) AS away, ts_us + (id % 300) * 60000000 AS seen FROM q), n AS (SELECT max(ts_us) - 86400000000 AS now FROM q)
SELECT id, home + away AS total FROM r, n WHERE home >= 0 AND away >= 0 AND home + away <= 40 AND seen >= kick_off + 9000000000 AND now >= kick_off + 9000000000
""")
def q_settled_totals(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.quotes import settled_totals

    q = quotes(spark, sf)
    now = q.agg((F.max("ts_us") - 86_400_000_000).alias("now"))  # one row
    r = q.select("id", F.col("ts_us").alias("kick_off"), (F.col("id") % 24 - 1).alias("home"), (F.col("id") % 29 - 1).alias("away"), (F.col("ts_us") + F.col("id") % 300 * 60_000_000).alias("seen")).join(F.broadcast(now))
    return settled_totals(r, F.col("now")).select("id", "total")
