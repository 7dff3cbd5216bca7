"""Lines, picks and alerts by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import lines as L

FIXTURE = "id long, market_mean double, prior_mean double, prior_variance double, reliable boolean, dispersion double, trust double, residual_bias double, residual_weight double, adopted boolean, suspended boolean, drifting boolean, audited boolean, lines array<struct<line:double,status:string,high_odds:double,low_odds:double>>"
PLAIN = {"market_mean": 9.4, "prior_mean": None, "prior_variance": None, "reliable": None, "dispersion": 0.0, "trust": 1.0, "residual_bias": None, "residual_weight": None, "adopted": None, "suspended": None, "drifting": None, "audited": True}


def fixtures(spark, *rows):
    return spark.createDataFrame([(i, *(PLAIN | r).values()) for i, r in enumerate(rows)], FIXTURE)


def line(x, high, low, status="AVAILABLE"):
    return x, status, high, low


def test_quarter_lines_are_half_returned(spark):
    m = F.array(*[F.lit(0.3 if k == 9 else 0.2 if k == 10 else 0.5 if k == 11 else 0.0) for k in range(15)])
    o = spark.range(1).select(L.outcome(m, F.lit(10.25)).alias("q"), L.outcome(m, F.lit(10.0)).alias("w"), L.outcome(m, F.lit(99.5)).alias("far"), L.outcome(m, F.lit(-0.5)).alias("low")).first()
    assert tuple(o.q) == pytest.approx((0.5, 0.1, 0.4)) and tuple(o.w) == pytest.approx((0.5, 0.2, 0.3)) and tuple(o.far) == pytest.approx((0, 0, 1)) and tuple(o.low) == pytest.approx((1, 0, 0))
    assert o.q.win * (2.0 - 1) - o.q.loss == pytest.approx(0.1)


def test_masses_of_wide_and_plain_counts(spark):
    r = spark.range(1).select(L.masses(F.lit(9.4), F.lit(0.0)).alias("p"), L.masses(F.lit(9.4), F.lit(0.06)).alias("w")).first()
    assert sum(r.p) == pytest.approx(1) and sum(r.w) == pytest.approx(1, abs=1e-6) and r.p[9] == pytest.approx(math.exp(-9.4) * 9.4**9 / math.factorial(9))
    var = lambda m: sum(k * k * x for k, x in enumerate(m)) - sum(k * x for k, x in enumerate(m)) ** 2
    assert var(r.p) == pytest.approx(9.4, rel=1e-6) and var(r.w) == pytest.approx(9.4 * (1 + 0.06 * 9.4), rel=1e-3) and sum(r.w[14:]) > sum(r.p[14:]) and sum(r.w[:5]) > sum(r.p[:5])


def test_a_reliable_prior_moves_the_mean_only_partly(spark):
    ask = lambda **k: {"lines": [line(9.5, 1.9, 1.9)], **k}
    rows = [ask(), ask(prior_mean=12.0, prior_variance=0.006, reliable=True), ask(prior_mean=12.0, prior_variance=0.006, reliable=False), ask(prior_mean=12.0, prior_variance=1e-9, reliable=True)]
    got = {r.id: r.mean for r in L.assessed(fixtures(spark, *rows)).collect()}
    assert got[0] == got[2] == 9.4 and got[1] == pytest.approx(math.sqrt(9.4 * 12.0)) and got[3] == pytest.approx(12.0, rel=1e-3)


def test_trust_draws_to_the_market_and_residuals_correct_it(spark):
    rows = [{"lines": [line(9.5, 2.6, 1.5)], "trust": t} for t in (1.0, 0.0, 0.5)] + [{"lines": [line(9.5, 2.6, 1.5)], "adopted": True, "residual_bias": 0.2, "residual_weight": 0.0}]
    a, b, c, d = L.assessed(fixtures(spark, *rows)).orderBy("id").collect()
    assert b.high == pytest.approx(b.fair_high) and c.high == pytest.approx((a.high + b.high) / 2) and a.high == a.raw
    assert math.log(d.high / (1 - d.high)) == pytest.approx(math.log(d.fair_high / (1 - d.fair_high)) + 0.2)
    half = L.assessed(fixtures(spark, rows[0]), calibrate=lambda p: p / 2).first()
    assert half.calibrated == pytest.approx(half.raw / 2) and half.high == pytest.approx(half.raw / 2)


def test_picks_watches_and_lines_that_cannot_be_taken(spark):
    rows = [
        {"lines": [line(9.5, 2.4, 1.6), line(9.5, 2.4, 1.6)]},  # equals: the first line
        {"lines": [line(9.5, 2.4, 1.6)], "suspended": True},
        {"lines": [line(9.5, 1.85, 1.85)]},
        {"lines": [line(9.5, 9.0, 9.0, "SUSPENDED")]},
        {"lines": [line(9.5, None, 1.9), line(9.5, 1.0, 1.9)]},
        {"lines": []},
        {"lines": [line(9.5, 2.4, 1.6)], "market_mean": None},
        {"lines": [line(9.5, 1.4, 2.9)], "drifting": True},
    ]
    got = {r.id: r for r in L.picks(fixtures(spark, *rows)).collect()}
    assert set(got) == {0, 1, 2, 3, 7}
    assert (got[0].kind, got[0].direction, got[0].line, got[0].lines, got[0].required) == ("pick", "high", 9.5, 2, None)
    assert got[1].kind == "watch" and got[1].edge == pytest.approx(got[0].edge) and got[1].required < got[1].probability
    assert got[2].kind == "watch" and got[2].edge < 0.02 and got[2].required == pytest.approx(1.02 / 1.85) and got[2].required > got[2].probability
    assert got[3].kind is None and got[3].confidence is None and got[7].direction == "low" and got[7].confidence <= 0.30


def test_trust_is_earned_and_lost(spark):
    rows = spark.createDataFrame([(None, None, False, 0.9), (0.8, 10, False, 0.9), (0.8, 40, True, 0.9), (0.2, 40, True, 0.9), (0.8, 40, False, 1.0)], "s double, n int, d boolean, w double")
    got = [r[0] for r in rows.select(L.trust(F.col("s"), F.col("n"), F.col("d"), F.col("w"))).collect()]
    assert got == pytest.approx([0.55, 0.8, 0.35, 0.2, 0.8])
    w = spark.createDataFrame([(0.5, 45.0), (2.0, 900.0), (None, 3.0)], "r double, k double")
    assert [r[0] for r in w.select(L.weather_dispersion(F.col("r"), F.col("k"))).collect()] == pytest.approx([0.023, 0.032, 0.0])


def test_half_lines_alerts_and_open_trades(spark):
    rows = spark.createDataFrame([("E0:1", 9.5), ("E0:2", 9.0), ("E1:3", 8.5), ("E0:4", 9.25), (None, 9.5), ("E0:5", None)], "k string, line double")
    assert [r.k for r in L.half_lines(rows, "k", "E0").collect()] == ["E0:1"]
    p = spark.createDataFrame([(1, 0.5, 0.44), (2, 0.5, 0.46), (3, 0.3, 0.5), (4, 0.6, 0.5), (5, None, 0.1)], "id int, m double, k double")
    assert [r.id for r in L.alerts(p, "m", "k").collect()] == [4, 1]
    t = spark.createDataFrame([(1, None, 5, 1), (2, 9, 99, 9), (3, None, 7, 1), (4, None, 7, 2), (5, 1, 100, 0)], "id int, settled int, event int, created int")
    assert [r.id for r in L.open_first(t, [], "settled", "event", "created").orderBy("place").collect()] == [4, 3, 1, 5, 2]
