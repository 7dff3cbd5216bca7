"""Strengths that drift, as of the day before, and learners that are replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kalman, replay, shots
from ..registry import query
from .joins import O, Q, orders, quotes


@query(f"""
WITH RECURSIVE {O}, d AS (SELECT key, day, sum(1 / r) AS h, sum(z / r) AS u FROM (SELECT key, day, ln(price / 150000) AS z, 0.2 + (id % 5) / 10 AS r FROM o) GROUP BY key, day),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM d),
s AS (SELECT key, 0::BIGINT AS i, day, 0.0::DOUBLE AS m0, 0.03::DOUBLE AS p0, 0.0::DOUBLE AS m, 0.03::DOUBLE AS p FROM r WHERE i = 1
  UNION ALL SELECT key, i, day, m0, p0, (m0 + u * p0) / (1 + h * p0), p0 / (1 + h * p0)
  FROM (SELECT r.key, r.i, r.day, r.h, r.u, k * s.m AS m0, k * k * s.p + (1 - k * k) * 0.03 AS p0
    FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1, LATERAL (SELECT exp(-(r.day - s.day) / 260.0) AS k)))
SELECT key, day, round(m0, 9) AS prior_mean, round(p0, 9) AS prior_variance, round(m, 9) AS mean, round(p, 9) AS variance FROM s WHERE i > 0
""")
def q_kalman_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = kalman.levels(orders(spark, sf), ["key"], "day", F.log(F.col("price") / 150000), 0.2 + (F.col("id") % 5) / 10)
    return out.select("key", "day", *[F.round(c, 9).alias(c) for c in ("prior_mean", "prior_variance", "mean", "variance")])


#: Orders as matches: five leagues of eighty teams, each with a support division; every eleventh is not played yet.
M = f"""{O}, matches AS (SELECT key % 5 AS league, day, id, key % 40 + 1 AS home, (key * 7 + id) % 40 + 41 AS away, CASE WHEN id % 11 <> 0 THEN floor(price / 30000) END AS home_n,
  CASE WHEN id % 11 <> 0 THEN (id % 9)::DOUBLE END AS away_n, id % 4 <> 0 AS top FROM o)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    key, id_, played = F.col("key"), F.col("id"), F.col("id") % 11 != 0
    return orders(spark, sf).select(
        (key % 5).alias("league"), "day", "id", (key % 40 + 1).alias("home"), ((key * 7 + id_) % 40 + 41).alias("away"),
        F.when(played, F.floor(F.col("price") / 30000)).cast("double").alias("home_n"), F.when(played, id_ % 9).cast("double").alias("away_n"), (id_ % 4 != 0).alias("top"),
    )


# a row of s holds a league's whole state after a match: lists over teams, and their copies as of the day's start
@query(f"""
WITH RECURSIVE {M}, r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY day, id) AS i FROM matches),
z AS (SELECT list_transform(range(80), lambda x: 0.0::DOUBLE) AS zero, list_transform(range(80), lambda x: 0.03::DOUBLE) AS wide, list_transform(range(80), lambda x: NULL::BIGINT) AS never),
s AS (
  SELECT DISTINCT league, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS day, NULL::BIGINT AS home, NULL::BIGINT AS away, zero AS a, zero AS d, wide AS va, wide AS vd, zero AS m, never AS l,
    5.5::DOUBLE AS lh, 4.8::DOUBLE AS la, 4.0::DOUBLE AS lw, 0.0::DOUBLE AS n, 0.0::DOUBLE AS e,
    zero AS a0, zero AS d0, wide AS va0, wide AS vd0, zero AS m0, never AS l0, 5.5::DOUBLE AS lh0, 4.8::DOUBLE AS la0, 0.0::DOUBLE AS n0, 0.0::DOUBLE AS e0
  FROM r, z
  UNION ALL
  SELECT league, i, id, day, home, away,
    CASE WHEN played THEN list_transform(a, lambda x, k: CASE k WHEN home THEN ah + vah / th * sh WHEN away THEN aa + vaa / ta * sa ELSE x END) ELSE a END,
    CASE WHEN played THEN list_transform(d, lambda x, k: CASE k WHEN home THEN dh + vdh / ta * sa WHEN away THEN da + vda / th * sh ELSE x END) ELSE d END,
    CASE WHEN played THEN list_transform(va, lambda x, k: CASE k WHEN home THEN vah * (1 - vah / th) WHEN away THEN vaa * (1 - vaa / ta) ELSE x END) ELSE va END,
    CASE WHEN played THEN list_transform(vd, lambda x, k: CASE k WHEN home THEN vdh * (1 - vdh / ta) WHEN away THEN vda * (1 - vda / th) ELSE x END) ELSE vd END,
    CASE WHEN played THEN list_transform(m, lambda x, k: CASE WHEN k IN (home, away) THEN x + w ELSE x END) ELSE m END,
    CASE WHEN played THEN list_transform(l, lambda x, k: CASE WHEN k IN (home, away) THEN day ELSE x END) ELSE l END,
    CASE WHEN played AND top THEN (lh * lw + home_n) / (lw + 1) ELSE lh END, CASE WHEN played AND top THEN (la * lw + away_n) / (lw + 1) ELSE la END,
    CASE WHEN played AND top THEN least(lw + 1, 300) ELSE lw END, CASE WHEN played AND top THEN n + 1 ELSE n END,
    CASE WHEN played AND top THEN e + ((home_n + away_n - mu) * (home_n + away_n - mu) - mu) / (mu * mu) ELSE e END,
    a0, d0, va0, vd0, m0, l0, lh0, la0, n0, e0
  FROM (SELECT *, vah + vda + 1 / greatest(x, 0.5) / w AS th, vaa + vdh + 1 / greatest(y, 0.5) / w AS ta, ln((home_n + 0.5) / (greatest(x, 0.2) + 0.5)) AS sh, ln((away_n + 0.5) / (greatest(y, 0.2) + 0.5)) AS sa, greatest(x + y, 0.001) AS mu
    FROM (SELECT *, lh * exp(ah + da) AS x, la * exp(aa + dh) AS y
      FROM (SELECT *, a[home] * kh AS ah, d[home] * kh AS dh, kh * kh * va[home] + (1 - kh * kh) * 0.03 AS vah, kh * kh * vd[home] + (1 - kh * kh) * 0.03 AS vdh,
          a[away] * ka AS aa, d[away] * ka AS da, ka * ka * va[away] + (1 - ka * ka) * 0.03 AS vaa, ka * ka * vd[away] + (1 - ka * ka) * 0.03 AS vda
        FROM (SELECT r.*, r.home_n IS NOT NULL AS played, CASE WHEN r.top THEN 1.0 ELSE 0.55 END AS w, exp(-least(r.day - coalesce(s.l[r.home], r.day), 400) / 260.0) AS kh, exp(-least(r.day - coalesce(s.l[r.away], r.day), 400) / 260.0) AS ka,
            s.a, s.d, s.va, s.vd, s.m, s.l, s.lh, s.la, s.lw, s.n, s.e,
            CASE WHEN r.day IS DISTINCT FROM s.day THEN s.a ELSE s.a0 END AS a0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.d ELSE s.d0 END AS d0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.va ELSE s.va0 END AS va0,
            CASE WHEN r.day IS DISTINCT FROM s.day THEN s.vd ELSE s.vd0 END AS vd0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.m ELSE s.m0 END AS m0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.l ELSE s.l0 END AS l0,
            CASE WHEN r.day IS DISTINCT FROM s.day THEN s.lh ELSE s.lh0 END AS lh0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.la ELSE s.la0 END AS la0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.n ELSE s.n0 END AS n0, CASE WHEN r.day IS DISTINCT FROM s.day THEN s.e ELSE s.e0 END AS e0
          FROM s JOIN r ON r.league = s.league AND r.i = s.i + 1))))),
p AS (SELECT *, l0[home] IS NOT NULL AND l0[away] IS NOT NULL AS known, exp(-least(day - l0[home], 400) / 260.0) AS kh, exp(-least(day - l0[away], 400) / 260.0) AS ka FROM s WHERE i > 0),
t AS (SELECT *, lh0 * exp(a0[home] * kh + d0[away] * ka) AS x, la0 * exp(a0[away] * ka + d0[home] * kh) AS y,
    kh * kh * va0[home] + (1 - kh * kh) * 0.03 + ka * ka * vd0[away] + (1 - ka * ka) * 0.03 AS vx, ka * ka * va0[away] + (1 - ka * ka) * 0.03 + kh * kh * vd0[home] + (1 - kh * kh) * 0.03 AS vy FROM p),
v AS (SELECT *, (x / (x + y)) * (x / (x + y)) * vx + (y / (x + y)) * (y / (x + y)) * vy AS lv FROM t)
SELECT id, CASE WHEN known THEN round(x, 6) END AS home_mean, CASE WHEN known THEN round(y, 6) END AS away_mean, CASE WHEN known THEN round(lv, 9) END AS log_variance,
  CASE WHEN known THEN round(CASE WHEN n0 >= 30 THEN greatest(e0 / n0, 0) ELSE 0 END, 6) END AS dispersion, CASE WHEN known THEN round(least(m0[home], m0[away]), 6) END AS team_matches,
  known AND least(m0[home], m0[away]) >= 6 AND lv < 0.05 AS reliable FROM v
""")
def q_kalman_strengths(spark: SparkSession, sf: str) -> DataFrame:
    out = kalman.strengths(matches(spark, sf))
    digits = {"home_mean": 6, "away_mean": 6, "log_variance": 9, "dispersion": 6, "team_matches": 6}
    return out.select("id", *[F.round(c, n).alias(c) for c, n in digits.items()], "reliable")


#: Events as settled forecasts of three members, twenty keys; some are void, broken, or came after the market had moved.
S = f"""{Q}, obs AS (SELECT key % 20 AS key, ts_us, id, (kind = 'view')::DOUBLE AS y, (1 + id % 97) / 99.0::DOUBLE AS pa, 0.2::DOUBLE AS pb, key % 10 / 10.0::DOUBLE AS pc, (id % 40 - 20) / 100.0::DOUBLE AS shift,
  CASE WHEN id % 31 = 0 THEN 'void' WHEN id % 29 = 0 THEN 'data error' WHEN abs((id % 40 - 20) / 100.0::DOUBLE) >= 0.18 THEN 'market move' ELSE 'healthy' END AS kind FROM q)"""


def settled(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    rows = q.select((F.col("key") % 20).alias("key"), "ts_us", "id", (F.col("kind") == "view").cast("double").alias("target"), F.when(F.col("id") % 29 != 0, (1 + F.col("id") % 97) / 99.0).alias("a"), F.lit(0.2).alias("b"), (F.col("key") % 10 / 10.0).alias("c"))
    return replay.observations(rows, ["a", "b", "c"], voided=F.col("id") % 31 == 0, shift=(F.col("id") % 40 - 20) / 100.0)


@query(f"""
WITH RECURSIVE {S}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM obs),
s AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS id, '' AS kind, 1 AS version, 0 AS used, 0 AS rollbacks, NULL::DOUBLE AS blend, 0.0::DOUBLE AS total, 0.0::DOUBLE AS la, 0.0::DOUBLE AS lb, 0.0::DOUBLE AS lc,
    1 / 3.0::DOUBLE AS a, 1 / 3.0::DOUBLE AS b, 1 / 3.0::DOUBLE AS c, NULL::DOUBLE AS ca, NULL::DOUBLE AS cb, NULL::DOUBLE AS cc, NULL::DOUBLE AS cl,
    0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS cum, 0.0::DOUBLE AS low, 0 AS m, 0.0::DOUBLE AS up FROM r
  UNION ALL
  SELECT key, i, id, CASE WHEN drift THEN 'model drift' ELSE kind END, version + drift::INT, used, rollbacks + drift::INT, blend, total, la, lb, lc,
    CASE WHEN drift THEN coalesce(ca, 1 / 3.0) ELSE a END, CASE WHEN drift THEN coalesce(cb, 1 / 3.0) ELSE b END, CASE WHEN drift THEN coalesce(cc, 1 / 3.0) ELSE c END,
    CASE WHEN take THEN a ELSE ca END, CASE WHEN take THEN b ELSE cb END, CASE WHEN take THEN c ELSE cc END, CASE WHEN take THEN total / used ELSE cl END,
    CASE WHEN drift THEN 0 ELSE n END, CASE WHEN drift THEN 0 ELSE mean END, CASE WHEN drift THEN 0 ELSE cum END, CASE WHEN drift THEN 0 ELSE low END, CASE WHEN drift THEN 0 ELSE m END, CASE WHEN drift THEN 0 ELSE up END
  FROM (SELECT *, learns AND NOT drift AND used % 25 = 0 AND (cl IS NULL OR total / used < cl) AS take
    FROM (SELECT *, learns AND (n >= 20 AND cum - low > 0.35 OR m >= 20 AND up > 0.25) AS drift
      FROM (SELECT * REPLACE (CASE WHEN learns THEN least(low, cum) ELSE low END AS low)
        FROM (SELECT * REPLACE (CASE WHEN learns THEN cum + loss - mean - 0.005 ELSE cum END AS cum,
            CASE WHEN NOT learns THEN a WHEN sa <= 0.03 THEN 0.03 ELSE sa / free * rest END AS a, CASE WHEN NOT learns THEN b WHEN sb <= 0.03 THEN 0.03 ELSE sb / free * rest END AS b, CASE WHEN NOT learns THEN c WHEN sc <= 0.03 THEN 0.03 ELSE sc / free * rest END AS c)
          FROM (SELECT *, 1 - 0.03 * ((sa <= 0.03)::INT + (sb <= 0.03)::INT + (sc <= 0.03)::INT) AS rest, CASE WHEN sa <= 0.03 THEN 0 ELSE sa END + CASE WHEN sb <= 0.03 THEN 0 ELSE sb END + CASE WHEN sc <= 0.03 THEN 0 ELSE sc END AS free
            FROM (SELECT *, xa / (xa + xb + xc) AS sa, xb / (xa + xb + xc) AS sb, xc / (xa + xb + xc) AS sc
              FROM (SELECT * REPLACE (CASE WHEN learns THEN n + 1 ELSE n END AS n, CASE WHEN learns THEN mean + (loss - mean) / (n + 1) ELSE mean END AS mean, CASE WHEN learns THEN m + 1 ELSE m END AS m,
                  CASE WHEN learns THEN greatest(0, up + loss - least(ea, eb, ec) - 0.004) ELSE up END AS up, CASE WHEN learns THEN used + 1 ELSE used END AS used, CASE WHEN learns THEN total + loss ELSE total END AS total,
                  CASE WHEN learns THEN la + ea ELSE la END AS la, CASE WHEN learns THEN lb + eb ELSE lb END AS lb, CASE WHEN learns THEN lc + ec ELSE lc END AS lc), a * exp(-0.6 * ea) AS xa, b * exp(-0.6 * eb) AS xb, c * exp(-0.6 * ec) AS xc
                FROM (SELECT *, (blend - y) ** 2 AS loss
                  FROM (SELECT s.* EXCLUDE (key, i, id, kind, blend), r.key, r.i, r.id, r.kind, r.y, r.kind IN ('healthy', 'market move') AS learns, (pa - y) ** 2 AS ea, (pb - y) ** 2 AS eb, (pc - y) ** 2 AS ec,
                      CASE WHEN r.kind IN ('healthy', 'market move') THEN (a * pa + b * pb + c * pc) / (a + b + c) END AS blend FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1))))))))))
SELECT key, id, kind, version, used, rollbacks, round(blend, 9) AS blend, round(total / nullif(used, 0), 9) AS blend_loss, round(least(la, lb, lc) / nullif(used, 0), 9) AS champion_loss, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM s WHERE i > 0
""")
def q_replay(spark: SparkSession, sf: str) -> DataFrame:
    out = replay.replayed(settled(spark, sf), ["a", "b", "c"])
    return out.select("key", "id", "kind", "version", "used", "rollbacks", *[F.round(c, 9).alias(c) for c in ("blend", "blend_loss", "champion_loss", "a", "b", "c")])


@query(f"""
WITH RECURSIVE {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM (SELECT key % 20 AS key, ts_us, id, (kind = 'view')::DOUBLE AS y, (1 + id % 97) / 99.0::DOUBLE AS p, (id % 21) / 20.0::DOUBLE AS k FROM q) WHERE k > 0 AND k < 1),
s AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS id, 0 AS used, 0.0::DOUBLE AS total, 0.0::DOUBLE AS market, 0.25::DOUBLE AS a, 0.25::DOUBLE AS b, 0.25::DOUBLE AS c, 0.25::DOUBLE AS d, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS cum, 0.0::DOUBLE AS low FROM r
  UNION ALL
  SELECT key, i, id, used, total, market, CASE WHEN drift THEN 0.25 ELSE a END, CASE WHEN drift THEN 0.25 ELSE b END, CASE WHEN drift THEN 0.25 ELSE c END, CASE WHEN drift THEN 0.25 ELSE d END,
    CASE WHEN drift THEN 0 ELSE n END, CASE WHEN drift THEN 0 ELSE mean END, CASE WHEN drift THEN 0 ELSE cum END, CASE WHEN drift THEN 0 ELSE low END
  FROM (SELECT *, n >= 20 AND cum - low > 0.35 AS drift
    FROM (SELECT * REPLACE (least(low, cum) AS low, CASE WHEN a <= 0.03 THEN 0.03 ELSE a / free * rest END AS a, CASE WHEN b <= 0.03 THEN 0.03 ELSE b / free * rest END AS b, CASE WHEN c <= 0.03 THEN 0.03 ELSE c / free * rest END AS c, CASE WHEN d <= 0.03 THEN 0.03 ELSE d / free * rest END AS d)
      FROM (SELECT * REPLACE (cum + loss - mean - 0.005 AS cum), 1 - 0.03 * ((a <= 0.03)::INT + (b <= 0.03)::INT + (c <= 0.03)::INT + (d <= 0.03)::INT) AS rest,
          CASE WHEN a <= 0.03 THEN 0 ELSE a END + CASE WHEN b <= 0.03 THEN 0 ELSE b END + CASE WHEN c <= 0.03 THEN 0 ELSE c END + CASE WHEN d <= 0.03 THEN 0 ELSE d END AS free
        FROM (SELECT * REPLACE (mean + (loss - mean) / n AS mean, a / (a + b + c + d) AS a, b / (a + b + c + d) AS b, c / (a + b + c + d) AS c, d / (a + b + c + d) AS d)
          FROM (SELECT key, i, id, used + 1 AS used, total + loss AS total, market + (k - y) ** 2 AS market, n + 1 AS n, mean, cum, low, loss, a * exp(-0.6 * (p1 - y) ** 2) AS a, b * exp(-0.6 * (p2 - y) ** 2) AS b, c * exp(-0.6 * (p3 - y) ** 2) AS c, d * exp(-0.6 * (p4 - y) ** 2) AS d
            FROM (SELECT *, ((a * p1 + b * p2 + c * p3 + d * p4) / (a + b + c + d) - y) ** 2 AS loss
              FROM (SELECT s.* EXCLUDE (key, i, id), r.*, k + 0.25 * (p - k) AS p1, k + 0.55 * (p - k) AS p2, k + 0.85 * (p - k) AS p3, p AS p4 FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1))))))))
SELECT key, id, used, round(CASE WHEN used < 30 THEN 0.55 ELSE (0.25 * a + 0.55 * b + 0.85 * c + d) / (a + b + c + d) END, 9) AS share, round(total / used, 9) AS loss, round(market / used, 9) AS market_loss FROM s WHERE i > 0
""")
def q_anchor(spark: SparkSession, sf: str) -> DataFrame:
    rows = quotes(spark, sf).select((F.col("key") % 20).alias("key"), "ts_us", "id", (F.col("kind") == "view").cast("double").alias("y"), ((1 + F.col("id") % 97) / 99.0).alias("model"), ((F.col("id") % 21) / 20.0).alias("market"))
    out = replay.anchored(rows)
    return out.select("key", "id", "used", *[F.round(c, 9).alias(c) for c in ("share", "loss", "market_loss")])


B = M.replace("id % 4 <> 0 AS top FROM o)", "id % 4 <> 0 AS top, CASE WHEN id % 17 <> 0 THEN (5 + id % 13)::DOUBLE END AS home_shots, (3 + id // 2 % 11)::DOUBLE AS away_shots, (key % 7 + 1)::INT AS judge FROM o)")
GAIN = "(1 - power(0.5::DOUBLE, 1 / 26.0::DOUBLE))"


@query(f"""
WITH RECURSIVE {B}, r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY day, id) AS i FROM matches),
z AS (SELECT list_transform(range(80), lambda x: 0.0::DOUBLE) AS zero, list_transform(range(80), lambda x: NULL::BIGINT) AS never, list_transform(range(7), lambda x: 0.0::DOUBLE) AS none),
s AS (
  SELECT DISTINCT league, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS day, NULL::BIGINT AS home, NULL::BIGINT AS away, NULL::INT AS judge, zero AS a, zero AS d, zero AS c, zero AS m, never AS l, none AS jt, none AS jn,
    13.5::DOUBLE AS hs, 11.5::DOUBLE AS s2, 5.5::DOUBLE AS hn, 4.8::DOUBLE AS an, 4.0::DOUBLE AS lw, 0.0::DOUBLE AS n, 0.0::DOUBLE AS e,
    zero AS a0, zero AS d0, zero AS c0, zero AS m0, never AS l0, none AS jt0, none AS jn0, 13.5::DOUBLE AS hs0, 11.5::DOUBLE AS s20, 5.5::DOUBLE AS hn0, 4.8::DOUBLE AS an0, 0.0::DOUBLE AS n0, 0.0::DOUBLE AS e0
  FROM r, z
  UNION ALL
  SELECT league, i, id, day, home, away, judge,
    CASE WHEN played THEN list_transform(a, lambda x, k: CASE k WHEN home THEN ha WHEN away THEN x + g * (ln(greatest(away_shots, 0.5) / greatest(t2, 0.5)) - hd - x) ELSE x END) ELSE a END,
    CASE WHEN played THEN list_transform(d, lambda x, k: CASE k WHEN home THEN hd WHEN away THEN x + g * (ln(greatest(home_shots, 0.5) / greatest(t1, 0.5)) - ha - x) ELSE x END) ELSE d END,
    CASE WHEN played THEN list_transform(c, lambda x, k: CASE k WHEN home THEN x + g * (ln((home_n + 0.5) / (greatest(home_shots, 0.5) * u1 / greatest(t1, 0.001) + 0.5)) - x) WHEN away THEN x + g * (ln((away_n + 0.5) / (greatest(away_shots, 0.5) * u2 / greatest(t2, 0.001) + 0.5)) - x) ELSE x END) ELSE c END,
    CASE WHEN played THEN list_transform(m, lambda x, k: CASE WHEN k IN (home, away) THEN x + w ELSE x END) ELSE m END, CASE WHEN played THEN list_transform(l, lambda x, k: CASE WHEN k IN (home, away) THEN day ELSE x END) ELSE l END,
    CASE WHEN played AND top THEN list_transform(jt, lambda x, k: CASE WHEN k = judge THEN x + ln((home_n + away_n + 0.5) / (greatest(u1 + u2, 0.5) + 0.5)) ELSE x END) ELSE jt END, CASE WHEN played AND top THEN list_transform(jn, lambda x, k: CASE WHEN k = judge THEN x + 1 ELSE x END) ELSE jn END,
    t1, t2, u1, u2, CASE WHEN played AND top THEN least(lw + 1, 300) ELSE lw END, CASE WHEN played AND top THEN n + 1 ELSE n END,
    CASE WHEN played AND top THEN e + ((home_n + away_n - mu) * (home_n + away_n - mu) - mu) / (mu * mu) ELSE e END, a0, d0, c0, m0, l0, jt0, jn0, hs0, s20, hn0, an0, n0, e0
  FROM (SELECT *, a[home] + g * (ln(greatest(home_shots, 0.5) / greatest(t1, 0.5)) - d[away] - a[home]) AS ha, d[home] + g * (ln(greatest(away_shots, 0.5) / greatest(t2, 0.5)) - a[away] - d[home]) AS hd
    FROM (SELECT *, greatest(hn * exp(a[home] + d[away] + c[home]) + an * exp(a[away] + d[home] + c[away]), 0.001) AS mu,
        CASE WHEN played AND top THEN (hs * lw + home_shots) / (lw + 1) ELSE hs END AS t1, CASE WHEN played AND top THEN (s2 * lw + away_shots) / (lw + 1) ELSE s2 END AS t2,
        CASE WHEN played AND top THEN (hn * lw + home_n) / (lw + 1) ELSE hn END AS u1, CASE WHEN played AND top THEN (an * lw + away_n) / (lw + 1) ELSE an END AS u2
      FROM (SELECT r.*, r.home_n IS NOT NULL AND r.home_shots IS NOT NULL AS played, CASE WHEN r.top THEN 1.0 ELSE 0.55 END AS w, CASE WHEN r.top THEN 1.0 ELSE 0.55 END * {GAIN} AS g,
          s.a, s.d, s.c, s.m, s.l, s.jt, s.jn, s.hs, s.s2, s.hn, s.an, s.lw, s.n, s.e,
          CASE WHEN same THEN s.a0 ELSE s.a END AS a0, CASE WHEN same THEN s.d0 ELSE s.d END AS d0, CASE WHEN same THEN s.c0 ELSE s.c END AS c0, CASE WHEN same THEN s.m0 ELSE s.m END AS m0, CASE WHEN same THEN s.l0 ELSE s.l END AS l0,
          CASE WHEN same THEN s.jt0 ELSE s.jt END AS jt0, CASE WHEN same THEN s.jn0 ELSE s.jn END AS jn0, CASE WHEN same THEN s.hs0 ELSE s.hs END AS hs0, CASE WHEN same THEN s.s20 ELSE s.s2 END AS s20,
          CASE WHEN same THEN s.hn0 ELSE s.hn END AS hn0, CASE WHEN same THEN s.an0 ELSE s.an END AS an0, CASE WHEN same THEN s.n0 ELSE s.n END AS n0, CASE WHEN same THEN s.e0 ELSE s.e END AS e0
        FROM (SELECT s.*, n.day IS NOT DISTINCT FROM s.day AS same FROM s JOIN r n ON n.league = s.league AND n.i = s.i + 1) s JOIN r ON r.league = s.league AND r.i = s.i + 1)))),
p AS (SELECT *, l0[home] IS NOT NULL AND l0[away] IS NOT NULL AS known, m0[home] / (m0[home] + 8) * exp(-least(day - l0[home], 400) / 260.0) AS kh, m0[away] / (m0[away] + 8) * exp(-least(day - l0[away], 400) / 260.0) AS ka,
  CASE WHEN jn0[judge] >= 12 THEN exp(jt0[judge] / (jn0[judge] + 25)) ELSE 1 END AS f, least(m0[home], m0[away]) AS k FROM s WHERE i > 0)
SELECT id, CASE WHEN known THEN round(hs0 * exp(a0[home] * kh + d0[away] * ka) * hn0 / hs0 * exp(c0[home] * kh) * f, 6) END AS home_mean, CASE WHEN known THEN round(s20 * exp(a0[away] * ka + d0[home] * kh) * an0 / s20 * exp(c0[away] * ka) * f, 6) END AS away_mean,
  CASE WHEN known THEN round(0.036 * (1 - k / (k + 8) * 0.85), 9) END AS log_variance, CASE WHEN known THEN round(CASE WHEN n0 >= 30 THEN greatest(e0 / n0, 0) ELSE 0 END, 6) END AS dispersion, CASE WHEN known THEN round(k, 6) END AS team_matches FROM p
""")
def q_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    keys = orders(spark, sf).select("id", (F.col("key") % 7 + 1).alias("judge"))
    rows = matches(spark, sf).withColumns({"home_shots": F.when(i % 17 != 0, 5 + i % 13), "away_shots": 3 + F.floor(i / 2) % 11}).join(keys, "id")
    out = shots.two_stage(rows)
    digits = {"home_mean": 6, "away_mean": 6, "log_variance": 9, "dispersion": 6, "team_matches": 6}
    return out.select("id", *[F.round(c, n).alias(c) for c, n in digits.items()])
