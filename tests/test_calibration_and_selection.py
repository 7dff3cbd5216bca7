"""Calibration by key, market residuals, features' worth, places and bootstraps: by hand and by brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import bootstrap, calibration, places, selection
from tideline.operators.models import folds


def samples(spark, *groups):
    rows = []
    for key, n, p, rate, seed in groups:
        r = random.Random(seed)
        rows += [(key, i, q := p if p is not None else r.random(), int(r.random() < (rate if rate is not None else 0.5 + (q - 0.5) / 2))) for i in range(n)]
    return spark.createDataFrame(rows, "key long, id long, p double, y int")


def test_the_ladder_climbs_with_the_sample(spark):
    rows = samples(spark, (1, 20, 0.8, 0.3, 1), (2, 120, 0.9, 0.4, 2), (3, 400, None, None, 3), (None, 300, None, 0.5, 4))
    odd = spark.createDataFrame([(4, 1, None, 1), (4, 2, float("nan"), 1), (4, 3, 1.5, 1), (4, 4, 0.5, None)], rows.schema)
    models = calibration.ladder(rows.unionAll(odd), ["key"], "p", "y")
    assert {r.key: (r.method, r.n) for r in models.collect()} == {1: ("identity", 20), 2: ("temperature", 120), 3: ("isotonic", 400), None: ("isotonic", 300)}
    asked = spark.createDataFrame([(1, 0.8), (2, 0.9), (3, 0.95), (3, 0.05), (3, None), (9, 0.4), (9, 1.7), (None, 0.0), (None, 1.0)], "key long, p double")
    got = {(r.key, r.p): r.calibrated for r in calibration.calibrated(asked, models, ["key"], "p").collect()}
    assert got[1, 0.8] == 0.8 and got[2, 0.9] < 0.6 and got[3, 0.95] < 0.95 and got[3, 0.05] > 0.05 and got[3, None] is None
    assert got[9, 0.4] == 0.4 and got[9, 1.7] == 1.0 and got[None, 0.0] <= got[None, 1.0]


def isotonic(p, y):
    """The least squares rising steps by the min-max formula."""
    cells = sorted(set(p))
    n = [sum(q == c for q in p) for c in cells]
    h = [sum(b for q, b in zip(p, y, strict=True) if q == c) for c in cells]
    mean = lambda j, k: sum(h[j : k + 1]) / sum(n[j : k + 1])
    return {c: max(min(mean(j, k) for k in range(i, len(cells))) for j in range(i + 1)) for i, c in enumerate(cells)}


def test_isotonic_steps_against_the_min_max_formula(spark):
    r = random.Random(5)
    rows = [(k, i, round(r.random(), 2), int(r.random() < 0.5)) for k in (1, 2) for i in range(260)]
    frame = spark.createDataFrame(rows, "key long, id long, p double, y int").repartition(5)
    got = {(x.key, x.p): x.calibrated for x in calibration.calibrated(frame, calibration.ladder(frame, ["key"], "p", "y"), ["key"], "p").collect()}
    for k in (1, 2):
        want = isotonic([p for a, _, p, _ in rows if a == k], [y for a, _, _, y in rows if a == k])
        assert all(got[k, p] == pytest.approx(v, abs=1e-12) for p, v in want.items())


def test_pooling_parts_first_changes_nothing():
    r = np.random.default_rng(3)
    value, weight, bound = r.random(200), r.integers(1, 5, 200).astype(float), np.arange(200.0)
    whole = calibration.pooled(bound, value, weight)
    parts = [b for s in np.split(np.arange(200), [7, 60, 61, 150]) for b in calibration.pooled(bound[s], value[s], weight[s])]
    again = calibration.pooled(*np.array(parts).T)
    assert np.allclose(whole, again)


def test_reports_of_scores(spark):
    rows = [(1, 0.5, i % 2) for i in range(10)] + [(2, 0.9, 0) for _ in range(10)] + [(3, float(i % 2), i % 2) for i in range(60)] + [(4, float(i % 2), 1 - i % 2) for i in range(60)]
    got = {r.key: r for r in calibration.report(spark.createDataFrame(rows, "key long, p double, y int"), ["key"], "p", "y").collect()}
    assert got[1].expected_error == 0 and not got[1].reliable and got[2].expected_error == pytest.approx(0.9) and got[2].skill == 0
    assert got[3].brier == 0 and got[3].beats and got[4].brier == 1 and not got[4].beats


def market(n, noise, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        q = 0.35 + 0.3 * r.random()
        truth, model = (q, q + (r.random() - 0.5) * 0.2) if noise else (q + 0.08, q + 0.06)
        out.append((int(r.random() < truth), model, q, 3_600_000_000 * i, i))
    return out


MARKET = "key long, y int, model double, market double, ts_us long, id long"


def test_a_known_bias_is_corrected_and_noise_is_not(spark):
    rows = [(k, *x) for k, n, noise in ((1, 59, False), (2, 4000, False), (3, 4000, True)) for x in market(n, noise, k)] + [(1, 1, 1.0, 0.5, 1, 900), (1, 1, 0.5, None, 1, 901), (1, None, 0.5, 0.5, 1, 902)]
    models = calibration.residuals(spark.createDataFrame(rows, MARKET), ["key"], "model", "market", "y")
    got = {r.key: r for r in models.collect()}
    assert got[1].n == 59 and not got[1].adopted and got[1].weight == 0 and got[1].holdout == 0
    assert got[2].adopted and got[2].brier < got[2].market_brier and got[2].log_loss < got[2].market_log_loss and got[2].holdout == 1200
    asked = spark.createDataFrame([(1, 0.42, 0.75), (2, 0.50, 0.58), (2, 0.5, 1 - 1e-9), (2, 0.5, float(1 / (1 + np.exp(-2.0))))], "key long, market double, model double")
    out = {(r.key, r.model): r.corrected for r in calibration.corrected(asked, models, ["key"], "model", "market").collect()}
    assert out[1, 0.75] == 0.42 and out[2, 0.58] > 0.5 and out[2, 1 - 1e-9] == pytest.approx(out[2, float(1 / (1 + np.exp(-2.0)))])


def test_keys_too_large_for_a_group_are_fitted_by_passes(spark):
    frame = spark.createDataFrame([(k, *x) for k in (1, 2, None) for x in market(200, False, k or 9)], MARKET)
    how = {"steps": 6}
    a, b = ({r.key: r for r in calibration.residuals(frame, ["key"], "model", "market", "y", cells=c, **how).collect()} for c in (10**6, 10))
    assert all(a[k].bias == pytest.approx(b[k].bias, rel=1e-12) and a[k].weight == pytest.approx(b[k].weight, rel=1e-12) and a[k].bias != 0 for k in (1, 2, None))


def test_the_earliest_share_of_each_key(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(3) * 86_400_000_000 + r.randrange(5), i) for i, k in enumerate([1] * 37 + [2] * 5 + [3] + [None] * 9)]
    got = {x.id: x.learns for x in calibration.earliest(spark.createDataFrame(rows, "key long, ts_us long, id long"), ["key"], "ts_us", "id", 0.7, "learns").collect()}
    for key in (1, 2, 3, None):
        mine = sorted((t, i) for k, t, i in rows if k == key)
        cut = max(1, int(len(mine) * 0.7 + 1e-9))
        assert [got[i] for _, i in mine] == [True] * cut + [False] * (len(mine) - cut)


# features -----------------------------------------------------------------------------------------


def season(n=600, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = r.poisson(np.clip(10 + 2.0 * x[:, 0] - 1.0 * x[:, 1], 0.1, None)).astype(float)
    return pd.DataFrame(x, columns=list("abcd")).assign(y=y, day=np.arange(n) // 2)


def refitted(frame, parts, kept, line=9.5, ridge=1e-3):
    """Each fold fitted again from its rows."""
    mae = brier = n = 0
    for fold in sorted(set(parts["fold"])):
        days = lambda p: set(parts[(parts["fold"] == fold) & (parts["part"] == p)]["day"])  # noqa: B023, E731
        train, test = frame[frame["day"].isin(days("train"))], frame[frame["day"].isin(days("test"))]
        mean, std = train[kept].mean(), train[kept].std(ddof=0)
        z = ((train[kept] - mean) / std).to_numpy()
        w = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(len(kept)), z.T @ (train["y"] - train["y"].mean()) / len(z)) if kept else np.zeros(0)
        guess = np.maximum(((test[kept] - mean) / std).to_numpy() @ w + train["y"].mean(), 0.05)
        above = 1 - np.array([sum(np.exp(-g) * g**k / np.prod(np.arange(1, k + 1)) for k in range(10)) for g in guess])
        mae, brier, n = mae + np.abs(guess - test["y"]).sum(), brier + ((above - (test["y"] > line)) ** 2).sum(), n + len(test)
    return mae / n, brier / n


def test_every_subset_scores_as_if_it_were_fitted_again(spark):
    frame = season()
    rows = spark.createDataFrame(frame)
    parts = folds(rows, "day", 3).toPandas()
    sweep = selection.Sweep(rows, list("abcd"), "y", "day")
    subsets = [list(s) for k in range(5) for s in itertools.combinations(range(4), k)]
    got = sweep.summary(subsets)
    for i, s in enumerate(subsets):
        assert (got["mae"][i], got["brier"][i]) == pytest.approx(refitted(frame, parts, [list("abcd")[j] for j in s]), rel=1e-8)


def test_what_features_are_worth(spark, monkeypatch):
    rows = spark.createDataFrame(season()).withColumn("b", F.when(F.col("day") == 5, None).otherwise(F.col("b")))
    a = selection.ablation(rows, list("abcd"), "y", "day").set_index("feature")
    assert a["mae_delta"]["a"] > a["mae_delta"]["b"] > max(abs(a["mae_delta"]["c"]), abs(a["mae_delta"]["d"])) and set(a["folds"]) == {3}
    s = selection.selected(rows, list("abcd"), "y", "day", most=2)
    assert s["features"] == ["a", "b"] and s["adopted"] and s["kept_mae"] <= s["base_mae"]
    few = selection.selected(rows.where("day < 20"), list("abcd"), "y", "day")
    assert few["features"] == list("abcd") and not few["adopted"] and few["note"] == "too few folds"
    assert len(selection.ablation(rows.limit(0), list("abcd"), "y", "day")) == 0


# places and bootstraps ----------------------------------------------------------------------------


def walked(win, slots, power):
    """Every order of the first few, with its chance."""
    out = [0.0] * len(win)
    win = [max(p or 0.0, 1e-9) for p in win]
    for first in itertools.permutations(range(len(win)), slots):
        chance, left = 1.0, set(range(len(win)))
        for depth, i in enumerate(first):
            w = {j: win[j] ** (power if depth else 1.0) for j in left}
            chance *= w[i] / sum(w.values())
            left.remove(i)
        for i in first:
            out[i] += chance
    return out


def test_places_against_every_order(spark):
    r = np.random.default_rng(7)
    cases = [(r.dirichlet(np.ones(n)).tolist(), s, power) for n in (4, 6, 9) for s in (1, 2, 3) for power in (1.0, 0.86)] + [([0.999999, 5e-7, 3e-7, 2e-7], 3, 0.86), ([1.0, 0.0, 0.0, None, 0.0], 2, 1.0)]
    for win, slots, power in cases:
        got = spark.createDataFrame([(win, slots)], "w array<double>, s int").select(places.placed(F.col("w"), F.col("s"), power)).first()[0]
        assert got == pytest.approx(walked(win, slots, power), rel=1e-6, abs=1e-9) and sum(got) == pytest.approx(slots, rel=1e-6)
    frame = spark.createDataFrame([([0.6, 0.4], 0), ([0.6, 0.4], 2), ([0.6, 0.4], 5), ([], 3), ([0.125] * 8, 3)], "w array<double>, s int")
    assert [x[0] for x in frame.select(places.placed(F.col("w"), F.col("s"))).collect()] == [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [], pytest.approx([0.375] * 8)]


def test_fields_of_fourteen(spark):
    rows = [(k, i, p) for k in range(40) for i, p in enumerate(np.random.default_rng(k).dirichlet(np.ones(14)).tolist())] + [(99, 0, 0.6), (99, 1, 0.4), (99, 2, None)]
    out = places.place_probabilities(spark.createDataFrame(rows, "race long, n long, win double"), ["race"], ["n"], "win", power=0.86)
    sums = {r.race: r.s for r in out.groupBy("race").agg(F.sum("place").alias("s")).collect()}
    assert out.columns == ["race", "n", "win", "place"] and sums.pop(99) == 0 and all(s == pytest.approx(3) for s in sums.values())
    assert out.where("place < win and race <> 99").count() == 0


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(200_000).select(bootstrap.weight((F.col("id") % 200).cast("string"), F.floor(F.col("id") / 200), 5).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 200_000 for r in w}
    for k, p in enumerate([0.36788, 0.36788, 0.18394, 0.06131, 0.01533]):
        assert share[float(k)] == pytest.approx(p, abs=0.005)


def test_intervals_like_those_of_drawn_blocks(spark):
    r = np.random.default_rng(5)
    rows = pd.DataFrame({"day": np.repeat(np.arange(300), 3), "stake": 1.0, "gain": r.normal(0.05, 1.5, 900)})
    got = bootstrap.intervals(spark.createDataFrame(rows), ["day"], F.col("gain"), F.col("stake")).first()
    daily = rows.groupby("day")[["gain", "stake"]].sum().to_numpy()
    drawn = np.sort([(x := daily[r.integers(0, 300, 300)].sum(axis=0))[0] / x[1] for _ in range(2000)])
    spread = drawn[1899] - drawn[100]
    assert got.blocks == 300 and got.roi == pytest.approx(rows["gain"].mean())
    for name, q in (("p50", 0.05), ("p950", 0.95), ("p25", 0.025), ("p975", 0.975)):
        assert got[name] == pytest.approx(drawn[int(1999 * q + 0.5)], abs=0.1 * spread)
    again = bootstrap.intervals(spark.createDataFrame(rows).repartition(7), ["day"], F.col("gain"), F.col("stake")).first()
    assert [again[k] for k in ("p50", "p975")] == pytest.approx([got[k] for k in ("p50", "p975")])
    none = bootstrap.intervals(spark.createDataFrame(rows).limit(0), ["day"], F.col("gain"), F.col("stake")).first()
    assert tuple(none) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def sided(spark, chances, days=100, bets=10, seed=3):
    """Bets at even odds that win with a chance by part of the days: development, validation, locked."""
    r = random.Random(seed)
    rows = []
    for d in range(days):
        p = chances[0 if d < days * 0.7 else 1 if d < days * 0.85 else 2]
        rows += [(d, 0.1, 2.0, r.random() < p) for _ in range(bets)]
    return spark.createDataFrame(rows, "day long, value double, odds double, won boolean")


def test_the_locked_days_have_the_last_word(spark):
    from tideline.operators import policy

    ask = lambda *a, **k: policy.gate(sided(spark, *a, **k), iterations=200).first()
    good = ask((0.5, 0.7, 0.7))
    assert good.enabled and good.reason == "passed" and good.validation_bets == 150 and good.locked_bets == 150 and 0 < good.locked_lower < good.locked_roi
    assert ask((0.7, 0.7, 0.3)).reason == "locked lower return not positive" and ask((0.7, 0.3, 0.9)).reason == "lower return not positive"
    assert ask((0.7, 0.7, 0.7), days=19).reason == "too few days" and ask((0.7, 0.7, 0.7), bets=1).reason == "too few bets"
    few = sided(spark, (0.7, 0.8, 0.8)).where("day < 85 or day = 99")
    assert policy.gate(few, iterations=200, least=60).first().reason in ("passed", "too few locked bets")
    none = policy.gate(sided(spark, (0.5, 0.5, 0.5)).limit(0), iterations=20).first()
    assert not none.enabled and none.locked_bets == 0 and none.locked_lower == -1.0
