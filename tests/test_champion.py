"""The two gates, by losses worked out by hand, and what a fitted race looks like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import champion as C
from tideline.operators import models

COLUMNS = "race long, day long, n long, won int, placed int, good double, horse_win_rate double, horse_finish_score double, jockey_win_rate double, trainer_win_rate double, recent_form_score double, weight_norm double, place_rate double"


def races(spark, n=150, field=8, signal=2.0, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        good = r.normal(size=field)
        order = np.argsort(-(signal * good + r.gumbel(size=field)))
        finish = np.empty(field, dtype=int)
        finish[order] = np.arange(1, field + 1)
        rows += [(k, k // 2, i, int(finish[i] == 1), int(finish[i] <= 3), float(good[i]), *[float(x) for x in r.random(6)], 0.3) for i in range(field)]
    return spark.createDataFrame(rows, COLUMNS)


def test_the_logistic_regression_by_hand(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    w = np.zeros(3)
    z = np.c_[np.ones(300), x]
    for _ in range(60):
        w = w - 0.045 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 300 + 0.004 * w * [0, 1, 1])
    assert models.logistic(rows, ["a", "b"], "y") == pytest.approx(w.tolist(), rel=1e-10)


def test_the_learners_minimise_their_losses(spark):
    rows, names = races(spark, 60, 6), ["good", "weight_norm"]
    p = rows.toPandas().sort_values(["race", "n"]).reset_index(drop=True)
    z = ((p[names] - p[names].mean()) / p[names].std(ddof=0)).to_numpy()
    one = np.c_[np.ones(len(z)), z]

    def choice(w):
        raw = np.exp(z @ w).reshape(60, 6)
        return -np.log((raw / raw.sum(axis=1, keepdims=True))[p["won"].to_numpy().reshape(60, 6) == 1]).sum() + 0.004 * 60 / 2 * w @ w

    def odds(w):
        chance, y = 1 / (1 + np.exp(-one @ w)), p["placed"].to_numpy()
        return -(y * np.log(chance) + (1 - y) * np.log(1 - chance)).sum() + 0.004 * 360 / 2 * w @ w

    for learn, target, design, loss in ((C.by_choice, "won", z, choice), (C.by_odds, "placed", one, odds)):
        raw = learn(rows, names, target, "race")(rows).toPandas().sort_values(["race", "n"])["__raw"].to_numpy()
        w = np.linalg.lstsq(design, np.log(raw) if loss is choice else np.log(raw / (1 - raw)), rcond=None)[0]
        steps = [by * np.eye(len(w))[i] for i in range(len(w)) for by in (0.02, -0.02)]
        assert all(loss(w) < loss(w + step) for step in steps)


def test_races_are_split_in_order_of_time(spark):
    rows = C.parts(races(spark, 20, 3), "race", "day")
    got = {r["__part"]: (r.n, r.low, r.high) for r in rows.groupBy("__part").agg(F.count_distinct("race").alias("n"), F.min("race").alias("low"), F.max("race").alias("high")).collect()}
    assert got == {"development": (14, 0, 13), "validation": (3, 14, 16), "holdout": (3, 17, 19)}


def test_losses_by_hand(spark):
    rows = races(spark, 30, 5)
    raw = lambda d: d.withColumn("__raw", F.exp("good"))
    got = C.judged(rows, "race", "won", "placed", "place_rate", raw, raw)
    p = rows.toPandas()
    p["e"] = np.exp(p["good"])
    p["p"] = p["e"] / p.groupby("race")["e"].transform("sum")
    base = np.exp(sum(p[c] * w for c, w in C.BASELINE.items()))
    p["b"] = base / base.groupby(p["race"]).transform("sum")
    winners = p[p["won"] == 1]
    assert got["win"] == pytest.approx(-np.log(winners["p"]).mean()) and got["baseline_win"] == pytest.approx(-np.log(winners["b"]).mean())
    assert got["place"] == pytest.approx(((np.clip(2 * p["p"], 0, 1) - p["placed"]) ** 2).mean()) and got["baseline_place"] == pytest.approx(((0.4 - p["placed"]) ** 2).mean())
    assert got["races"] == got["winners"] == 30


def test_a_challenger_that_knows_passes_both_gates(spark):
    rows = races(spark)
    figures, predict = C.trained(rows, ["good", "weight_norm"], "race", "day", "won", "placed", "place_rate")
    assert figures["win"] == figures["validation_win"] == figures["place"] == "challenger" and figures["win_loss"] < figures["baseline_win_loss"] and figures["place_brier"] < figures["baseline_place_brier"]
    assert (figures["validation_races"], figures["holdout_races"]) == (22, 23)
    out = predict(rows)
    assert out.columns == [*rows.columns, "win", "place"]
    sums = out.groupBy("race").agg(F.sum("win").alias("w"), F.sum("place").alias("p"), F.max("place").alias("m")).agg(F.min("w"), F.max("w"), F.min("p"), F.max("p"), F.max("m")).first()
    assert sums[:4] == pytest.approx((1, 1, 3, 3), abs=1e-3) and sums[4] <= 1
    cards = C.assembled(out, ["race"], ["n"]).where("race = 3").first().runners
    assert [r.win for r in cards] == sorted((r.win for r in cards), reverse=True) and len(cards) == 8 and set(cards[0].asDict()) == {"n", "win", "place"}


def test_a_challenger_that_guesses_does_not_pass(spark):
    rows = races(spark, signal=0.0, seed=5)
    loud = lambda rows, features, target, race: lambda new: new.withColumn("__raw", F.exp(3 * F.col("good")))
    figures, predict = C.trained(rows, ["good"], "race", "day", "won", "placed", "place_rate", loud, loud)
    assert figures["win"] == figures["place"] == "baseline" and figures["win_loss"] == figures["baseline_win_loss"]
    same = predict(rows).withColumn("b", C.baseline("race")).where(F.abs(F.col("win") - F.col("b")) > 1e-12)
    assert same.count() == 0


def test_passing_the_first_gate_alone_is_not_enough(spark):
    rows = races(spark)
    seen = []

    def once(rows, features, target, race):
        seen.append(rows.count())
        sign = 2.0 if len(seen) <= 2 else -2.0  # knows, until it meets the holdout
        return lambda new: new.withColumn("__raw", F.exp(sign * F.col("good")))

    figures, _ = C.trained(rows, ["good"], "race", "day", "won", "placed", "place_rate", once, once)
    assert figures["validation_win"] == "challenger" and figures["win"] == "baseline" and seen == [840, 840, 1016, 1016]


def test_too_few_races_are_refused(spark):
    with pytest.raises(ValueError, match="rows at least"):
        C.trained(races(spark, 20), ["good"], "race", "day", "won", "placed", "place_rate")
    with pytest.raises(ValueError, match="winners"):
        C.trained(races(spark, 70), ["good"], "race", "day", "won", "placed", "place_rate")
