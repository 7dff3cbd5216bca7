"""Joins by time, distance, priority and fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import day_number, micros
from ..operators import joins as J
from ..registry import query, table
from .scalars import DRAW_SQL, draws

MINUTE = 60_000_000


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """id, key, kind, ts_us (microseconds since 1970), price of every event."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), micros("ts").alias("ts_us"), F.col("value").alias("price"))


Q = "q AS (SELECT event_id AS id, user_id AS key, event_type AS kind, epoch_us(ts) AS ts_us, value AS price FROM events)"


@query(f"""
WITH {Q}, d AS (SELECT id, key, ts_us - 600000000 AS cut FROM q WHERE kind = 'purchase'), v AS (SELECT * FROM q WHERE kind = 'view')
SELECT d.id, v.id AS quote_id, v.price FROM d ASOF LEFT JOIN v ON d.key = v.key AND d.cut >= v.ts_us
""")
def q_asof_latest_quote(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    d, v = q.where("kind = 'purchase'").select("id", "key", "ts_us"), q.where("kind = 'view'")
    return J.asof(d, v, ["key"], F.col("ts_us") - 10 * MINUTE, F.col("ts_us"), {"quote_id": F.col("id"), "price": F.col("price")}, tie=F.col("id")).select("id", "quote_id", "price")


@query(f"""
WITH {Q}, d AS (SELECT * FROM q WHERE kind = 'signup'), v AS (SELECT * FROM q WHERE kind <> 'error')
SELECT d.id, v.id AS closing_id, v.price AS closing FROM d ASOF LEFT JOIN v ON d.key = v.key AND d.ts_us > v.ts_us
""")
def q_asof_closing_quote(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    return J.asof(q.where("kind = 'signup'").select("id", "key", "ts_us"), q.where("kind <> 'error'"), ["key"], F.col("ts_us"), F.col("ts_us"), {"closing_id": F.col("id"), "closing": F.col("price")}, strict=True).select("id", "closing_id", "closing")


@query(f"""
WITH {Q}, d AS (SELECT * FROM q WHERE kind = 'click'), v AS (SELECT * FROM q WHERE kind = 'error'),
r AS (SELECT d.id, v.id AS near_id, abs(v.ts_us - d.ts_us) AS gap, row_number() OVER (PARTITION BY d.id ORDER BY abs(v.ts_us - d.ts_us), v.ts_us) AS n FROM d LEFT JOIN v ON d.key = v.key)
SELECT id, near_id, gap FROM r WHERE n = 1
""")
def q_nearest_quote(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    out = J.nearest(q.where("kind = 'click'").select("id", "key", "ts_us"), q.where("kind = 'error'"), ["key"], F.col("ts_us"), F.col("ts_us"), {"near_id": F.col("id"), "near_at": F.col("ts_us")})
    return out.select("id", "near_id", F.abs(F.col("near_at") - F.col("ts_us")).alias("gap"))


O = "o AS (SELECT o_orderkey AS id, o_custkey AS key, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_totalprice AS price FROM orders)"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """id, key, day, price of every order."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), day_number("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))


@query(f"WITH {O} SELECT a.id, count(b.id) AS n60 FROM o a LEFT JOIN o b ON a.key = b.key AND b.day BETWEEN a.day - 60 AND a.day GROUP BY a.id")
def q_trailing_count(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    return J.beside(o, J.trailing(o, ["key"], "day", 60, {"n60": F.lit(1)}, same_day=True), ["key", "day"]).select("id", "n60")


@query(f"""
WITH {O} SELECT a.id, count(b.id) AS n, round(coalesce(avg(b.price), 0), 6) AS mean, coalesce(min(b.price), 0) AS least
FROM o a LEFT JOIN o b ON a.key = b.key AND b.day BETWEEN a.day - 120 AND a.day - 1 GROUP BY a.id
""")
def q_trailing_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    t = J.trailing(o, ["key"], "day", 120, {"n": F.lit(1), "total": F.col("price")}, F.col("price"))
    zero = F.lit(0.0)
    return J.beside(o, t, ["key", "day"]).select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(F.col("total") / F.col("n"), zero), 6).alias("mean"), F.coalesce("least", zero).alias("least"))


@query(f"""
WITH {O}, c AS (SELECT a.id, count(b.id) AS n, min(b.id) AS m FROM o a LEFT JOIN o b ON a.key = b.key % 700 AND abs(a.day - b.day) <= 20 GROUP BY a.id)
SELECT id, CASE WHEN n = 1 THEN m END AS match FROM c
""")
def q_only_candidate(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    other = o.select((F.col("key") % 700).alias("key"), F.col("id").alias("other"), "day")  # a second feed, with keys of its own
    return J.only_candidate(o, other, ["key"], "id", "other", F.col("day"), F.col("day"), 20)


@query(f"""
WITH {O}, s AS (SELECT unnest([0, 1, 2]) AS rank, unnest([0, -1, 1]) AS shift),
c AS (SELECT a.id, rank, b.price, row_number() OVER (PARTITION BY a.id ORDER BY rank, b.price) AS n
  FROM o a CROSS JOIN s JOIN o b ON a.key % 50 = b.key % 50 AND b.day + 1 = a.day + shift)
SELECT o.id, c.price AS value FROM o LEFT JOIN c ON o.id = c.id AND n = 1
""")
def q_shifted_day(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf).withColumn("key", F.col("key") % 50)
    return J.by_shift(o, o, ["key"], "id", F.col("day"), F.col("day") + 1, F.col("price"))


@query("""
WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS known FROM part),
x AS (SELECT name, known, len(list_intersect(string_split(name, ' '), string_split(known, ' '))) AS shared,
  greatest(len(list_distinct(string_split(name, ' '))), len(list_distinct(string_split(known, ' ')))) AS longest FROM a CROSS JOIN b),
r AS (SELECT *, shared / longest::DOUBLE AS score, row_number() OVER (PARTITION BY name ORDER BY shared / longest::DOUBLE DESC, known) AS n FROM x WHERE shared / longest::DOUBLE >= 0.5)
SELECT a.name, r.known AS match, round(r.score, 6) AS score FROM a LEFT JOIN r ON a.name = r.name AND n = 1
""")
def q_shared_words(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    names = p.select(F.col("p_name").alias("name")).distinct()
    known = p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("known")).distinct()
    return J.resolved(names, known).withColumn("score", F.round("score", 6))


@query("""
WITH old AS (SELECT c_custkey, c_name || c_acctbal AS f FROM customer),
new AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name || c_acctbal END AS f FROM customer)
SELECT c_custkey, CASE WHEN old.f IS NULL THEN 'insert' WHEN new.f IS NULL THEN 'absent' WHEN old.f = new.f THEN 'keep' ELSE 'correct' END AS action
FROM old FULL JOIN new USING (c_custkey)
""")
def q_upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    print_ = F.concat("c_name", F.col("c_acctbal").cast("string"))
    new = F.when(k % 5 == 0, -k).otherwise(k).alias("c_custkey")  # a fifth is new to the store, as much is gone
    return J.actions(c.select(k, print_.alias("f")), c.select(new, F.when(k % 7 == 0, "x").otherwise(print_).alias("f")), "c_custkey", "f")


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS bal FROM customer)
SELECT c_custkey, coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM c)) AS bal FROM c
""")
def q_median_fill(spark: SparkSession, sf: str) -> DataFrame:
    return J.filled(table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("bal")), ["bal"])


@query("""
WITH y AS (SELECT o_custkey AS key, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT a.key, a.y::INT AS y, round(coalesce(b.total, a.total), 2) AS earlier, b.total IS NULL AS fell_back FROM y a LEFT JOIN y b ON a.key = b.key AND b.y = a.y - 1
""")
def q_lagged_season(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    before = y.select("key", (F.col("y") + 1).alias("y"), F.col("total").alias("before"))
    return y.join(before, ["key", "y"], "left").select("key", "y", F.round(F.coalesce("before", "total"), 2).alias("earlier"), F.col("before").isNull().alias("fell_back"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN coalesce(f.total, d.total) ELSE o_totalprice END AS result
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS total FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) f ON o_orderkey = f.l_orderkey
LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS total FROM lineitem GROUP BY 1) d ON o_orderkey = d.l_orderkey
""")
def q_settlement_precedence(spark: SparkSession, sf: str) -> DataFrame:
    most = F.max("l_extendedprice"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")))
    results = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(most[0].alias("d"), most[1].alias("f"))  # both in one pass
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(results, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.coalesce("f", "d")).otherwise(F.col("o_totalprice")).alias("result"))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), n AS (SELECT draw_id, unnest(numbers) AS n FROM d),
t AS (SELECT a.n AS x, b.n AS y, count(*) AS c FROM n a JOIN n b ON b.draw_id = a.draw_id + 1 GROUP BY 1, 2)
SELECT x.n AS x, y.n AS y, coalesce(c, 0) + 1 AS times FROM range(1, 50) x(n) CROSS JOIN range(1, 50) y(n) LEFT JOIN t ON t.x = x.n AND t.y = y.n
""")
def q_transitions(spark: SparkSession, sf: str) -> DataFrame:
    d = draws(spark, sf)
    after = d.select((F.col("draw_id") + 1).alias("draw_id"), F.col("numbers").alias("before")).join(d, "draw_id")  # a row a draw, then at most 36 pairs of it
    pairs = after.select(F.explode("before").alias("x"), "numbers").select("x", F.explode("numbers").alias("y")).groupBy("x", "y").agg(F.count("*").alias("c"))
    grid = spark.range(49 * 49).select((F.col("id") % 49 + 1).alias("x"), (F.floor(F.col("id") / 49) + 1).alias("y"))  # 49 x 49, whatever the draws
    return grid.join(pairs, ["x", "y"], "left").select("x", "y", (F.coalesce("c", F.lit(0)) + 1).alias("times"))


@query(f"""
WITH {DRAW_SQL.replace('SELECT', 'd AS (SELECT', 1)}), s AS (SELECT draw_id, list_sum(numbers)::DOUBLE AS s FROM d)
SELECT k::INT AS lag, round(corr(a.s, b.s), 6) AS r, count(*) AS n FROM s a CROSS JOIN range(3, 31) t(k) JOIN s b ON b.draw_id = a.draw_id + k GROUP BY 1
""")
def q_lag_correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = draws(spark, sf).select("draw_id", F.aggregate("numbers", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return J.lag_correlations(s, "draw_id", "s", range(3, 31)).withColumn("r", F.round("r", 6))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS k, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT a.k, count(*) AS pairs, count(*) FILTER (WHERE (a.p < b.p)) AS concordant FROM l a JOIN l b ON a.k = b.k AND a.q < b.q GROUP BY 1
""")
def q_concordant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")).alias("r")).distinct()
    a, b = rows.alias("a"), rows.alias("b")  # the runners of a race: a handful
    joined = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.r.q") < F.col("b.r.q")))
    return joined.groupBy(F.col("a.k").alias("k")).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("a.r.p") < F.col("b.r.p"), 1)).alias("concordant"))


@query(f"""
WITH {Q}, d AS (SELECT * FROM q WHERE kind = 'purchase'), v AS (SELECT * FROM q WHERE kind = 'view'),
j AS (SELECT d.price AS taken, d.ts_us, v.price AS closing, v.ts_us AS seen FROM d ASOF LEFT JOIN v ON d.key = v.key AND d.ts_us >= v.ts_us)
SELECT CASE WHEN taken <= 1 THEN 'bad price' WHEN closing IS NULL THEN 'no quote' WHEN closing <= 1 THEN 'bad quote' WHEN ts_us - seen > 86400000000 THEN 'stale quote' ELSE 'graded' END AS reason,
  count(*) AS n, round(avg(CASE WHEN closing > 1 AND taken > 1 AND ts_us - seen <= 86400000000 THEN taken / closing - 1 END), 6) AS mean_value FROM j GROUP BY 1
""")
def q_grade_reasons(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    d = q.where("kind = 'purchase'").select("id", "key", "ts_us", "price")
    j = J.asof(d, q.where("kind = 'view'"), ["key"], F.col("ts_us"), F.col("ts_us"), {"closing": F.col("price"), "seen": F.col("ts_us")}, tie=F.col("id"))
    reason = F.when(F.col("price") <= 1, "bad price").when(F.col("closing").isNull(), "no quote").when(F.col("closing") <= 1, "bad quote").when(F.col("ts_us") - F.col("seen") > 1440 * MINUTE, "stale quote").otherwise("graded")
    graded = F.when(reason == "graded", F.col("price") / F.col("closing") - 1)
    return j.select(reason.alias("reason"), graded.alias("g")).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean_value"))


@query(f"WITH {Q} SELECT key, kind, arg_max(price, ts_us) AS price, arg_max(id, ts_us) AS id FROM q GROUP BY 1, 2")
def q_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return quotes(spark, sf).groupBy("key", "kind").agg(F.max(F.struct("ts_us", "price", "id")).alias("m")).select("key", "kind", "m.price", "m.id")


@query("""
WITH q AS (SELECT l_suppkey AS k, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1),
p AS (SELECT CASE k % 4 WHEN 0 THEN 'H' || k WHEN 1 THEN lpad(k::VARCHAR, 9, '0') WHEN 2 THEN k::VARCHAR ELSE '?' || k END AS code, price FROM q)
SELECT s_suppkey, coalesce(a.price, b.price, c.price) AS price, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN p a ON a.code = 'H' || s_suppkey LEFT JOIN p b ON b.code = lpad(s_suppkey::VARCHAR, 9, '0') LEFT JOIN p c ON c.code = s_suppkey::VARCHAR
""")
def q_keyed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("k"), F.col("s_suppkey")
    code = F.when(k % 4 == 0, F.concat(F.lit("H"), k)).when(k % 4 == 1, F.lpad(k.cast("string"), 9, "0")).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(F.lit("?"), k))
    quoted = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_extendedprice"), 2).alias("price")).select(code.alias("code"), "price")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    found = J.first_key(suppliers, quoted, "s_suppkey", [F.concat(F.lit("H"), s), F.lpad(s.cast("string"), 9, "0"), s.cast("string")], "code", "price")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return suppliers.join(n, "s_nationkey").join(found, "s_suppkey").select("s_suppkey", "price", "n_name")


@query("""
WITH s AS (SELECT l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS code, round(avg(l_quantity), 4) AS xg FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, (o_custkey % (SELECT count(*) FROM supplier) + 1) || '|' || strftime(o_orderdate, '%Y-%m-%d') AS code FROM orders),
j AS (SELECT o_orderkey, xg FROM o LEFT JOIN s USING (code))
SELECT o_orderkey, coalesce(xg, (SELECT quantile_cont(xg, 0.5) FROM j)) AS xg FROM j
""")
def q_composite_lookup(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda k, d: F.concat_ws("|", k, F.date_format(d, "yyyy-MM-dd"))
    s = table(spark, sf, "lineitem").groupBy(code("l_suppkey", "l_shipdate").alias("code")).agg(F.round(F.avg("l_quantity"), 4).alias("xg"))
    n = table(spark, sf, "supplier").count()
    o = table(spark, sf, "orders").select("o_orderkey", code((F.col("o_custkey") % n + 1).cast("string"), "o_orderdate").alias("code"))
    return J.filled(o.join(s, "code", "left").select("o_orderkey", "xg"), ["xg"])


@query(f"""
WITH {Q}, p AS (SELECT (1 + id % 97) / 99.0::DOUBLE AS p, (2 + key % 45) / 50.0::DOUBLE AS m, kind = 'view' AS y FROM q),
g AS (SELECT w / 10.0::DOUBLE AS w, t, avg(power(1 / (1 + exp(-(w / 10.0::DOUBLE * ln(m / (1 - m)) + (1 - w / 10.0::DOUBLE) * ln(p / (1 - p))) / t)) - y::INT, 2)) AS b
  FROM p CROSS JOIN range(0, 11) x(w) CROSS JOIN (SELECT unnest([0.8::DOUBLE, 0.9, 1.0, 1.1, 1.2]) AS t) GROUP BY 1, 2)
SELECT w, t, round(b, 6) AS brier FROM g
""")
def q_blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = quotes(spark, sf).select(((1 + F.col("id") % 97) / 99.0).alias("p"), ((2 + F.col("key") % 45) / 50.0).alias("m"), (F.col("kind") == "view").cast("int").alias("y"))
    grid = [(w / 10.0, t) for w in range(11) for t in (0.8, 0.9, 1.0, 1.1, 1.2)]
    lm, lp = F.log(F.col("m") / (1 - F.col("m"))), F.log(F.col("p") / (1 - F.col("p")))
    # each row adds to all 55 cells in one pass, instead of 55 copies of it
    cells = [F.avg(F.pow(1 / (1 + F.exp(-(w * lm + (1 - w) * lp) / t)) - F.col("y"), 2)) for w, t in grid]
    named = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), c.alias("b")) for (w, t), c in zip(grid, cells, strict=True)])
    return p.agg(named.alias("g")).select(F.explode("g").alias("g")).select("g.w", "g.t", F.round("g.b", 6).alias("brier"))
