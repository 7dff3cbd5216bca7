"""Backtests block by block give what one fold over all draws gives."""

import random

import pytest

from tideline.operators import numbers as N


def frame(spark, n):
    r = random.Random(3)
    rows = [(5 * k, sorted(r.sample(range(1, 50), r.choice([6, 6, 5]))), None if k % 17 == 0 else k % 7, 0.0 if k % 13 == 0 else 1e6 * (1 + r.random() + (2 if k % 19 == 0 else 0))) for k in range(n)]
    return N.numbered(spark.createDataFrame(rows, "draw_id long, numbers array<int>, weekday int, turnover double"), "draw_id").repartition(5).persist()


@pytest.mark.parametrize("correcting, n", [(False, 1500), (True, 9000)])
def test_guesses_by_blocks_are_those_in_order(spark, correcting, n):
    draws = frame(spark, n)
    want = {r.i: r for r in N.backtest(N.scored(draws), correcting).collect()}
    got = {r.i: r for r in N.tested(draws, correcting, size=512, in_order=2048).collect()}
    assert sorted(got) == sorted(want) == list(range(100, n))
    for i, r in got.items():
        w = want[i]
        assert (r.picks, r.special, r.matches) == (w.picks, w.special, w.matches), i
        assert (r.confidence, r.rolling) == pytest.approx((w.confidence, w.rolling), rel=1e-9, abs=1e-12)
        assert tuple(r)[6:] == tuple(w)[6:]
    if correcting:  # the last weights have settled, and so the last draws came by blocks
        now = N.WEIGHTS | {m: want[n - 1][f"w_{m}"] for m in N.MODELS[:4]}
        assert N.corrected(now) == now


def test_the_backtest_hands_on_no_row_of_chances(spark):
    draws = frame(spark, 700)
    for in_order in (512, 1 << 14):
        plan = N.tested(draws, size=512, in_order=in_order)._jdf.queryExecution().optimizedPlan().toString()
        assert "markov#" not in plan.replace("w_markov#", "")
