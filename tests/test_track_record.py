"""The track record by hand, and falls from a peak against a walk through all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import track_record as T

HOUR = 3_600_000_000
KICK = 1000 * HOUR
FORECAST = "id long, match_id long, captured long, kick_off long, probability double, actual int, pick struct<line:double,direction:string,probability:double,market:double,odds:double,edge:double,recommended:boolean>"
QUOTE = "match_id long, line double, captured long, in_play boolean, over_odds double, under_odds double"


def forecast(i=1, p=0.62, actual=None, pick=None, match=1):
    return i, match, KICK - 3 * HOUR, KICK, p, actual, pick


def quote(minutes, over=1.95, under=1.85, match=1, line=9.5, in_play=False):
    return match, line, KICK - minutes * HOUR // 60, in_play, over, under


def made(spark, forecasts, quotes, after=3):
    out = T.entries(spark.createDataFrame(forecasts, FORECAST), spark.createDataFrame(quotes, QUOTE), KICK + after * HOUR)
    return {r.id: r for r in out.collect()}


def test_an_entry_carries_the_quote_that_stood(spark):
    e = made(spark, [forecast(actual=12)], [quote(30, 2.4, 1.6), quote(240), quote(600, 1.8, 2.0), quote(200, 9.0, 9.0, in_play=True), quote(0, 7.0, 7.0)])[1]
    assert (e.odds, e.taken_at, e.direction, e.closing_odds, e.won, e.refused) == (1.95, KICK - 4 * HOUR, "high", 2.4, True, None)
    assert e.closing_value == pytest.approx(1.95 / 2.4 - 1) and e.units == pytest.approx(0.95) and e.market == pytest.approx((1 / 1.95) / (1 / 1.95 + 1 / 1.85))


def test_the_side_follows_the_value(spark):
    e = made(spark, [forecast(p=0.30, actual=6), forecast(2, p=0.51, actual=12)], [quote(240)])
    assert e[1].direction == "low" and e[1].probability == pytest.approx(0.7) and e[1].won and e[1].recommended
    assert not e[2].recommended


def test_forecasts_are_refused_not_guessed(spark):
    rows = [forecast(1, match=1), forecast(2, p=None, match=1), forecast(3, match=2), forecast(4, match=3), forecast(5, match=4), forecast(6, match=5)]
    quotes = [quote(30, match=1), quote(240, match=2, line=8.5), quote(240, 1.0, 3.0, match=3), quote(240, None, 1.9, match=4), quote(240, match=5)]
    e = made(spark, rows, quotes)
    assert {i: r.refused for i, r in e.items()} == {1: "no quote", 2: "no side", 3: "no timeline", 4: "unusable odds", 5: "unusable odds", 6: None}
    assert all(e[i].odds is None and not e[i].recommended for i in range(1, 6))


def test_before_kick_off_there_is_no_close(spark):
    e = made(spark, [forecast()], [quote(240)], after=-1)[1]
    assert e.closing_odds is None and e.closing_value is None and not e.settled and e.won is None and e.units is None


def test_a_pick_stands_as_it_was_made(spark):
    pick = (10.5, "low", 0.6, 0.5, 2.2, 0.1, True)
    e = made(spark, [forecast(1, actual=10, pick=pick), forecast(2, p=None, actual=11, pick=(10.5, "low", 0.6, 0.5, 2.2, 0.01, True)), forecast(3, actual=9, pick=(10.5, "high", 0.6, 0.5, 2.2, 0.1, False), match=9)], [quote(30, 1.6, 2.4, line=10.5), quote(240)])
    assert (e[1].line, e[1].odds, e[1].closing_odds, e[1].won, e[1].recommended, e[1].taken_at) == (10.5, 2.2, 2.4, True, True, KICK - 3 * HOUR)
    assert not e[2].recommended and e[2].won is False and e[3].refused is None and not e[3].recommended and e[3].closing_odds is None


def test_the_summary(spark):
    rows = [forecast(1, actual=12), forecast(2, actual=3), forecast(3), forecast(4, p=0.5, actual=12)]
    rows = [(i, m, c, k + i * HOUR, p, a, x) for i, m, c, k, p, a, x in rows]
    s = T.summary(T.entries(spark.createDataFrame(rows, FORECAST), spark.createDataFrame([quote(240), quote(30, 1.9, 1.9)], QUOTE), KICK + 100 * HOUR)).first()
    assert (s.recommended, s.settled, s.hits, s.samples, s.closing_samples) == (3, 2, 1, 2, 3)
    assert s.net == pytest.approx(-0.05) and s.drawdown == pytest.approx(1.0) and s.brier == pytest.approx((0.38**2 + 0.62**2) / 2) and s.beat_closing == 1.0
    none = T.summary(T.entries(spark.createDataFrame([], FORECAST), spark.createDataFrame([], QUOTE), 0)).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0, 0.0, 0.0)


def test_falls_from_a_peak_against_a_walk(spark):
    r = random.Random(3)
    for n in (1, 40, 300):
        rows = [(i, r.randrange(12), r.choice([-1.0, 0.9, 2.0])) for i in range(n)]
        got = T.drawdown(spark.createDataFrame(rows, "id long, day long, g double").repartition(3), ["id"], "day", "g").first()
        at = peak = worst = 0.0
        for _, _, g in sorted(rows, key=lambda x: (x[1], x[0])):
            at += g
            peak = max(peak, at)
            worst = max(worst, peak - at)
        assert got.net == pytest.approx(at) and got.drawdown == pytest.approx(worst)
    assert T.drawdown(spark.range(0).select(F.col("id"), F.col("id").alias("day"), F.lit(1.0).alias("g")), ["id"], "day", "g").first()[:] == (0.0, 0.0)
