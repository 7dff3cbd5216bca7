"""Operators that SQL does not express, readers, writers and streams, on small hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import expressions as E
from tideline.operators import folds, joins, models
from tideline.sources import readers, writers
from tideline.streaming import quotes as streams


def test_settlement_of_split_lines(spark):
    rows = spark.createDataFrame([(10.25, 10.0), (10.25, 11.0), (10.25, 9.0), (10.0, 10.0), (9.75, 10.0)], "line double, total double")
    got = [r[0] for r in rows.select(E.profit(F.col("line"), F.col("total"), F.lit(2.0), F.lit(10.0))).collect()]
    assert got == [-5.0, 10.0, -10.0, 0.0, 5.0]


def test_distributions(spark):
    r = spark.range(1).select(E.negative_binomial_masses(F.lit(10.2), F.lit(0.08)).alias("m")).select("m", *[E.over_mass(F.col("m"), F.lit(x)).alias(f"o{i}") for i, x in enumerate((8.5, 9.5, 10.5))]).first()
    assert abs(sum(r.m) - 1) < 1e-9 and min(r.m) >= 0 and r.o0 > r.o1 > r.o2
    assert spark.range(1).select(E.falling(F.array(F.lit(0.9), F.lit(0.95), F.lit(0.4)))).first()[0] == [0.9, 0.9, 0.4]
    assert spark.range(1).select(E.choose(49, F.lit(6)), E.choose(49, F.lit(50))).first()[:] == (13983816, 0)


def test_prices(spark):
    rows = spark.createDataFrame([(1.9, 1.9), (1.0, 2.0)], "o double, u double")
    got = rows.select(E.fair(F.col("o"), F.col("u"))[0], E.usable_pair(F.col("o"), F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(0.5, True), (None, False)]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_across_buckets(spark, strict):
    rng = np.random.default_rng(1)
    l = [(i, int(rng.integers(3)), int(rng.integers(60))) for i in range(80)]
    r = [(i, int(rng.integers(3)), int(rng.integers(60))) for i in range(60)]
    left, right = spark.createDataFrame(l, "id long, k long, t long"), spark.createDataFrame(r, "rid long, k long, t long")
    got = joins.asof(left, right, ["k"], F.col("t"), F.col("t"), {"rid": F.col("rid")}, strict=strict, tie=F.col("rid"), bucket=7)
    want = {i: max(((t2, j) for j, k2, t2 in r if k2 == k and (t2 < t or t2 == t and not strict)), default=(0, None))[1] for i, k, t in l}
    assert {x.id: x.rid for x in got.collect()} == want
    assert joins.asof(left, right.limit(0), ["k"], F.col("t"), F.col("t"), {"rid": F.col("rid")}).where("rid is not null").count() == 0


def test_ratings_see_the_day_before(spark):
    rows = spark.createDataFrame([(1, 1, 1, 10, 11, 1.0), (1, 1, 2, 10, 12, 1.0), (1, 2, 3, 10, 11, 0.0)], "league long, day long, id long, home long, away long, score double")
    got = {r.id: r for r in folds.rating(rows).collect()}
    assert got[1].before_home == got[2].before_home == 1500.0
    gain = 20 * (1 - 1 / (1 + 10 ** (-60 / 400)))
    assert abs(got[3].before_home - (1500 + 2 * gain)) < 1e-9 and abs(got[3].before_away - (1500 - gain)) < 1e-9


def test_weights_keep_their_floor():
    w = folds.floored([0.9, 1e-9, 0.1, 1e-5], 0.03)
    assert abs(sum(w) - 1) < 1e-12 and min(w) == 0.03


def test_alarms(spark):
    rows = [(1, i, i, 0.1 if i < 60 else 0.9, 0.0) for i in range(100)] + [(2, i, i, 0.5, 0.1) for i in range(100)] + [(3, i, i, 0.5, -0.1 if i < 10 else 0.0) for i in range(40)]
    got = folds.alarms(spark.createDataFrame(rows, "key long, ts_us long, id long, loss double, difference double")).collect()
    assert {r.key for r in got if r.drifted} == {1}
    # 20 rows at least, then once every 20 rows, as each alarm starts the test again
    assert [r.id for r in sorted(got, key=lambda r: r.id) if r.degraded] == [19, 39, 59, 79, 99] and {r.key for r in got if r.degraded} == {2}
    assert [r.id for r in got if r.improved] == [19] and {r.key for r in got if r.improved} == {3}


def test_folds_keep_null_keys_apart(spark):
    rows = spark.createDataFrame([(None, 0, 0, "a"), (None, 1, 1, "b"), (1, 0, 2, "a")], "key long, ts_us long, id long, content string")
    got = {r.id: r.link for r in folds.chained(rows).collect()}
    assert len(set(got.values())) == 3
    other = rows.withColumn("content", F.when(F.col("id") == 0, "x").otherwise(F.col("content")))
    assert {r.id for r in folds.chained(other).collect() if got[r.id] == r.link} == {2}  # all later links of the key change


def test_reference_labels_and_times(spark):
    r = spark.range(1).select(*[E.price_bucket(F.lit(x)) for x in (1.5, 1.75, 2.0, 2.5, 3.0)], *[E.seconds(F.lit(t)) for t in ("1.09.45", "1:09:45", "in 0.57.30 today", "57.3", "300", "none")]).first()
    assert list(r) == ["1.01-1.75", "1.75-2.00", "2.00-2.50", "2.50-3.00", "3.00+", 69.45, 69.45, 57.3, 57.3, None, None]


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, None, 5), (2, 1, None), (3, 1, 5)], "id long, k long, t long")
    right = spark.createDataFrame([(7, None, 1), (8, 1, 1), (9, 1, None)], "rid long, k long, t long")
    got = joins.asof(left, right, ["k"], F.col("t"), F.col("t"), {"rid": F.col("rid")})
    assert {r.id: r.rid for r in got.collect()} == {1: None, 2: None, 3: 8}
    sums = spark.createDataFrame([(None, 3), (1, 4)], "k long, n long")
    assert {r.id: r.n for r in joins.beside(left, sums, ["k"]).collect()} == {1: 3, 2: 4, 3: 4}


QUOTES = [(1, 0, 0, 1.9), (1, 1, 60, 1.9), (1, 2, 120, 1.8), (1, 3, 800, 1.8), (2, 4, 5, 1.0)]


def test_change_log_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, t * 1_000_000, v) for k, i, t, v in QUOTES], "key long, id long, ts_us long, value double")
    assert sorted(r.id for r in folds.change_log(rows).collect()) == [0, 2, 3, 4]
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text("".join(json.dumps({"key": k, "id": i, "ts_us": t * 1_000_000, "value": v}) + "\n" for k, i, t, v in QUOTES[:2]) + "{broken\n")
    run = lambda: streams.run_once(streams.change_log(streams.read_landing(spark, str(landing), streams.LOG)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in run().collect()) == [0]
    (landing / "b.json").write_text("".join(json.dumps({"key": k, "id": i, "ts_us": t * 1_000_000, "value": v}) + "\n" for k, i, t, v in QUOTES[2:]))
    assert sorted(r.id for r in run().collect()) == [0, 2, 3, 4]
    starts = F.lit(70 * 1_000_000)
    assert streams.admitted(rows, F.col("ts_us"), starts, 0, 0).count() == 0


def test_isotonic_pools():
    p, n, hits = np.arange(5.0), np.array([1, 2, 1, 4, 1]), np.array([0, 2, 0, 1, 1])
    fitted = models.pooled(p, n, hits)
    assert (np.diff(fitted) >= 0).all() and abs((fitted * n).sum() - hits.sum()) < 1e-12
    assert np.allclose(fitted, [0, 3 / 7, 3 / 7, 3 / 7, 1])


def test_temperature_is_found(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = rng.random(20_000) < 1 / (1 + np.exp(-z))
    rows = spark.createDataFrame([(float(1 / (1 + np.exp(-1.5 * a))), int(b)) for a, b in zip(z, y, strict=True)], "p double, y int")
    assert abs(models.temperature(rows, "p", "y") - 1.5) < 0.08


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Team,Odds,Odds\nAlpha,2.1,2.2,,,\n\nBeta,1.5\n")
    got = readers.ragged_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["Team", "Odds", "Odds.1"]
    assert sorted(tuple(r) for r in got.collect()) == [("Alpha", "2.1", "2.2"), ("Beta", "1.5", None)]


def test_immutable_merge_refuses_a_rewrite(spark):
    old = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    same = spark.createDataFrame([(2, None), (3, 1.0)], "id long, v double")
    assert sorted(r.id for r in writers.merged(old, same, ["id"]).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="conflicting rows for 1"):
        writers.merged(old, spark.createDataFrame([(1, 3.0)], "id long, v double"), ["id"]).collect()


def test_newer_replaces(spark):
    make = lambda *rows: spark.createDataFrame(rows, "id long, t long, v string")
    got = writers.newest(make((1, 5, "a"), (2, 5, "a")), make((1, 5, "b"), (2, 6, "b"), (3, 1, "b")), ["id"], "t")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_stream_of_changes_becomes_snapshots(spark, tmp_path):
    import bz2

    from tideline.sources import exchange

    definition = {"eventName": "Arsenal v Chelsea", "name": "Corners Over/Under 10.5", "marketType": "OU", "marketTime": "2025-01-01T15:00:00.000Z", "inPlay": False, "runners": [{"id": 1, "name": "Over 10.5 Corners"}, {"id": 2, "name": "Under 10.5 Corners"}]}
    t0 = 1735741800000  # 14:30
    messages = [
        {"pt": t0, "mc": [{"id": "1.1", "marketDefinition": definition}]},
        {"pt": t0 + 1000, "mc": [{"id": "1.1", "rc": [{"id": 1, "ltp": 1.9}]}]},  # one side alone
        {"pt": t0 + 2000, "mc": [{"id": "1.1", "rc": [{"id": 2, "ltp": 2.0}]}]},
        {"pt": t0 + 3000, "mc": [{"id": "1.1", "rc": [{"id": 1, "ltp": 1.95}]}]},
        {"pt": t0 + 4000, "mc": [{"id": "1.1", "marketDefinition": definition | {"inPlay": True}}]},
        {"pt": t0 + 5000, "mc": [{"id": "1.1", "rc": [{"id": 1, "ltp": 1.5}]}]},  # in play
    ]
    (tmp_path / "a.bz2").write_bytes(bz2.compress(("\n\n".join(json.dumps(m) for m in messages) + "\n{broken").encode()))
    got = sorted(exchange.snapshots(exchange.read_stream(spark, str(tmp_path))).collect(), key=lambda r: r.captured_at)
    assert [(r.market_id, r.event_name, r.line, r.over_odds, r.under_odds, r.is_closing) for r in got] == [("1.1", "Arsenal v Chelsea", 10.5, 1.9, 2.0, False), ("1.1", "Arsenal v Chelsea", 10.5, 1.95, 2.0, True)]


def test_quotes_of_payloads(spark):
    from tideline.sources import exchange

    combos = [{"str": "H", "currentOdds": "1.85"}, {"str": "", "currentOdds": "1.95", "selections": [{"str": "L"}]}, {"str": "X", "currentOdds": "---"}, {"str": "Y", "currentOdds": "0"}]
    line = {"condition": "9.5", "status": "AVAILABLE", "combinations": combos}
    pools = [{"oddsType": "CHL", "lines": [line, {"condition": "10.5", "combinations": combos[2:]}]}, {"oddsType": "HIL", "lines": [line]}]
    match = {"id": "M1", "kickOffTime": "2025-01-01T15:00:00+00:00", "tournament": {"nameProfileId": "p"}, "homeTeam": {"name_ch": "h"}, "awayTeam": {"name_ch": "a"}, "foPools": pools}
    late, other, odd = match | {"kickOffTime": "2025-01-09T15:00:00+00:00"}, match | {"tournament": {"nameProfileId": "q"}}, match | {"kickOffTime": "soon"}
    rows = spark.createDataFrame([(json.dumps({"data": {"matches": [match, late, other, odd]}}),), ("{}",), ("no json",)], "payload string")
    got = exchange.football_quotes(rows, {"p": "one"}, F.to_timestamp(F.lit("2025-01-01T12:00:00Z"))).collect()
    assert [(r.key, r.league, r.odds, r.line_status, r.home, r.minutes) for r in got] == [("football:M1:CHL:9.5", "one", {"H": 1.85, "L": 1.95}, "AVAILABLE", "h", 180)]
    pool = lambda kind, races, nodes: {"oddsType": kind, "leg": {"races": races}, "oddsNodes": nodes}
    nodes = [{"combString": "01", "oddsValue": "3.5"}, {"combString": "02", "oddsValue": "SCR"}, {"combString": "01", "oddsValue": "3.6"}]
    meeting = {"meeting": {"date": "2025-01-01", "venueCode": "ST"}, "pools": [pool("WIN", [4], nodes), pool("PLA", [], nodes), pool("QIN", [4], nodes), pool("PLA", [5], nodes[1:2])]}
    got = exchange.racing_quotes(spark.createDataFrame([(json.dumps(meeting),)], "payload string")).collect()
    assert [(r.key, r.race_id, r.odds) for r in got] == [("racing:2025-01-01:ST:4:WIN", "HK:2025-01-01:ST:4", {"01": 3.6})]


def test_match_files(spark):
    from tideline.sources import matches

    rows = spark.createDataFrame([("E0", "17/08/93", "A", "B", "5", "3.0", "x"), ("E0", "17/08/2024", "A", "B", "5", None, "2"), ("E1", "2024-08-17", "A", "B", "5", "4", "2"), ("E0", "bad", "A", "B", "5", "3", "2")], "Div string, Date string, HomeTeam string, AwayTeam string, HC string, AC string, `Avg>2.5` string")
    got = matches.normalised_matches(rows, "2425", ["E0"]).collect()
    assert [(str(r.Date), r.HC, r.AC, r["Avg>2.5"], r.Season) for r in got] == [("1993-08-17", 5, 3, None, "2425")]
    assert matches.normalised_matches(rows.drop("HC"), "2425", ["E0"]) is None
    assert [r.Div for r in matches.normalised_fixtures(rows, ["E0", "E1"]).collect()] == ["E0", "E0", "E1"]


def test_bootstrap_and_policy(spark):
    import pandas as pd

    from tideline.operators import policy

    days = pd.DataFrame({"day": [3, 1, 2], "net": [1.0, -2.0, 0.5], "bets": [2, 3, 1]})
    rng, frame = np.random.default_rng(7), days.sort_values("day").set_index("day")
    drawn = [frame.loc[rng.choice(frame.index.to_numpy(), size=3, replace=True)] for _ in range(50)]
    assert policy.bootstrapped(days, 7, 50) == float(np.quantile([d["net"].sum() / d["bets"].sum() for d in drawn], 0.1))
    assert policy.bootstrapped(days[:0], 7) == -1.0
    rows = [(i // 5, 0.2, 0.1, 2.0, 2.0, i % 5 < 4) for i in range(200)] + [(i, 0.01, 0.01, 4.0, 4.0, False) for i in range(40)]
    sided = policy.sided(spark.createDataFrame(rows, "day long, over_value double, under_value double, over_odds double, under_odds double, over_won boolean"))
    assert {r.direction for r in sided.collect()} == {"over"}
    best = policy.chosen(policy.lower_returns(policy.grid_days(sided), 100)).first()
    assert best.enabled and (best.maximum_odds, best.minimum_value, best.bets) == (3.0, 0.0, 200) and abs(best.roi - 0.6) < 1e-9
    assert policy.chosen(policy.lower_returns(policy.grid_days(sided), 10), least=1000).first().reason == "too few bets"


def test_special_functions(spark):
    from tideline.functions import special as sp

    r = spark.range(1).select(
        sp.normal_cdf(F.lit(1.959963984540054)), sp.normal_quantile(F.lit(0.975)), sp.chi_square_tail(F.lit(3.841458820694124), F.lit(1.0)), sp.chi_square_tail(F.lit(67.50480654954126), F.lit(50.0)),
        sp.beta_quantile(F.lit(0.5), F.lit(2.0), F.lit(2.0)), sp.beta_quantile(F.lit(0.025), F.lit(1.0), F.lit(1.0)), sp.kolmogorov_tail(F.lit(1.3580986393225505)), sp.log_gamma(F.lit(0.5)),
    ).first()
    want = [0.975, 1.959963984540054, 0.05, 0.05, 0.5, 0.025, 0.05, 0.5723649429247001]
    assert all(abs(a - b) < 1e-6 for a, b in zip(r, want, strict=True)), list(r)


def test_published_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.12345678, "a"), (2, None, "b")], "id long, v double, t string")
    for _ in range(2):  # a second publication replaces the first
        writers.publish_json(rows, str(tmp_path / "j"))
        writers.publish_csv(rows, str(tmp_path / "c"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    assert sorted(r.t for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["a", "b"]
    assert json.loads(writers.versioned(rows).where("payload like '%\"id\":1%'").first().payload)["v"] == 0.123457
    one, other = writers.checksums(rows, ["id"]).collect(), writers.checksums(rows.orderBy(F.desc("id")).select("t", "v", "id"), ["id"]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(0, 1, 3000), np.repeat([1.0, 2.0, 1e9], [500, 900, 1]), np.array([3.0]), np.arange(4.0)):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for q in (0.0, 0.1, 0.5, 0.97, 1.0):
            assert abs(joins.quantile(rows, "v", q, held=20, bins=7) - np.quantile(x, q)) < 1e-12
    assert joins.quantile(rows.limit(0), "v", 0.5) is None


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    l = [(i, int(rng.integers(3)), int(rng.integers(90))) for i in range(60)] + [(90, None, 5), (91, 1, None)]
    r = [(i, int(rng.integers(3)), int(rng.integers(90))) for i in range(25)] + [(80, None, 5)]
    left, right = spark.createDataFrame(l, "id long, k long, t long"), spark.createDataFrame(r, "rid long, k long, t long")
    got = joins.nearest(left, right, ["k"], F.col("t"), F.col("t"), {"at": F.col("t")}, bucket=11).collect()
    want = {i: min(((abs(s - t), s) for _, m, s in r if m == k), default=(0, None))[1] if k is not None and t is not None else None for i, k, t in l}
    assert {x.id: x["at"] for x in got} == want


def test_rare_words_decide_who_meets(spark):
    r = np.random.default_rng(8)
    words = ["the", *[f"w{i}" for i in range(12)]]
    names = sorted({" ".join(r.choice(words, int(r.integers(1, 6)), replace=False)) for _ in range(60)})
    a, b = spark.createDataFrame([(n,) for n in names[::2]], "name string"), spark.createDataFrame([(n,) for n in names[1::2]], "known string")
    for least in (0.4, 0.5, 0.75):
        want = {}
        for n in names[::2]:
            s = sorted((-len(set(n.split()) & set(k.split())) / max(len(n.split()), len(k.split())), k) for k in names[1::2])
            want[n] = s[0][1] if s and -s[0][0] >= least else None
        assert {x.name: x.match for x in joins.resolved(a, b, least).collect()} == want


def test_candidates_learn_and_are_selected_before_the_locked_seasons(spark):
    from tideline.operators import candidates as C

    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        a = float(rng.random())
        rows.append((i, i // 3, i // 180, a, None if i % 10 == 0 else float(rng.random()), 9.0, int(rng.poisson(4 + 12 * a))))
    frame = spark.createDataFrame(rows, "id long, day long, season long, a double, b double, baseline double, total long")
    names = ("dynamic", "poisson_all", "boosting_recent", "residual_recent", "ensemble_all")
    got = C.walk_forward(frame, ["a", "b"], "total", "baseline", "season", "day", names, first=3, trees=8).cache()
    assert got.count() == 360
    mae = {r.candidate: r.mae for r in C.scores(got, "total", names).collect()}
    assert all(mae[n] < mae["dynamic"] for n in names[1:])
    assert C.selected(got, "total", "season", names, locked=1) != "dynamic"
    p = spark.createDataFrame([(0.8, int(x < 0.6)) for x in rng.random(2000)] + [(0.2, int(x < 0.4)) for x in rng.random(2000)], "p double, won int")
    intercept, slope = C.line_calibration(p, "p", "won")
    assert abs(intercept) < 0.1 and abs(slope - np.log(1.5) / np.log(4)) < 0.06  # p is too sure of itself
    runners = spark.createDataFrame([(r, i, float(rng.random())) for r in range(150) for i in range(4)], "race long, runner long, x double")
    won = runners.withColumn("won", (F.col("x") > 0.7).cast("int"))
    shares = C.winner_classifier(won, ["x"], "won", trees=3)(won)
    assert abs(shares.agg(F.sum("p")).first()[0] - 150) < 1e-6
    means = {r.won: r.m for r in shares.groupBy("won").agg(F.avg("p").alias("m")).collect()}
    assert means[1] > means[0]
