"""Drifting strengths and replayed learners: the cases a reader would check by hand, brute force, and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import kalman, replay
from tideline.streaming import replay as streamed

MATCHES = "league string, day long, id long, home string, away string, home_n int, away_n int, top boolean"


def history(days=40):
    rows = []
    for k in range(days):
        rows.append(("E", 7 * k, 2 * k, "city", "mid", 10, 4, True))
        rows.append(("E", 7 * k, 2 * k + 1, "rovers", "other", 2, 3, True))
    return rows


def asked(spark, rows):
    return {r.id: r for r in kalman.strengths(spark.createDataFrame(rows, MATCHES)).collect()}


def test_strengths_separate_high_from_low_and_revert(spark):
    end = 7 * 39
    fixtures = [("E", end + 3, 900, "city", "mid", None, None, True), ("E", end + 3, 901, "rovers", "other", None, None, True), ("E", end + 300, 902, "city", "mid", None, None, True), ("E", end + 3, 903, "city", "nowhere", None, None, True), ("F", end, 904, "city", "mid", None, None, True)]
    out = asked(spark, history() + fixtures)
    assert out[900].home_mean > out[901].home_mean and out[900].reliable and out[900].team_matches == 40
    assert out[900].home_mean + out[900].away_mean > out[902].home_mean + out[902].away_mean  # a stale strength goes back to the average
    assert out[902].log_variance > out[900].log_variance
    assert out[903].home_mean is None and out[904].home_mean is None and not out[903].reliable
    assert out[0].home_mean is None and out[1].home_mean is None  # nobody had played


def test_strengths_do_not_see_their_own_day(spark):
    rows = history(20)
    changed = [(g, d, i, h, a, 0 if d == 7 * 19 else x, 99 if d == 7 * 19 else y, t) for g, d, i, h, a, x, y, t in rows]
    a, b = asked(spark, rows), asked(spark, changed)
    assert a == b


def test_support_matches_count_less_and_leave_the_means_alone(spark):
    last = [("E", 400, 950, "city", "mid", None, None, True)]
    low = [(g, d, i, h, a, x, y, False) for g, d, i, h, a, x, y, _ in history(10)]
    out = asked(spark, low + last)[950]
    assert out.team_matches == pytest.approx(5.5) and out.dispersion == 0 and not out.reliable
    first = [("E", 1, 1, "a", "b", 3, 2, False), ("E", 2, 2, "a", "b", None, None, True)]
    r = asked(spark, first)[2]
    keep = math.exp(-1 / 260)
    gain = 0.03 / (0.06 + 1 / 5.5 / 0.55)
    shift = gain * math.log(3.5 / 6.0)
    assert r.home_mean == pytest.approx(5.5 * math.exp(2 * keep * shift))


def test_strengths_with_nulls_and_nothing(spark):
    rows = [("E", 1, 1, None, "b", 3, 2, True), (None, 1, 2, "a", "b", 3, 2, True), ("E", None, 3, "a", "b", 1, 1, True)]
    out = asked(spark, rows)
    assert len(out) == 3 and all(r.home_mean is None for r in out.values())
    assert asked(spark, rows[:0]) == {}


def filtered(rows, tau=260.0, p0=0.03):
    """The textbook filter, observation by observation; days in order."""
    out, state = {}, {}
    for key, day in sorted({(k, d) for k, d, _, _ in rows}, key=str):
        pass
    for key in {k for k, _, _, _ in rows}:
        m, p, last = 0.0, p0, None
        for day in sorted({d for k, d, _, _ in rows if k == key}):
            keep = math.exp(-(day - last) / tau) if last is not None else 1.0
            m, p, last = keep * m, keep * keep * p + (1 - keep * keep) * p0, day
            before = (m, p)
            for k, d, z, r in rows:
                if (k, d) == (key, day):
                    gain = p / (p + r)
                    m, p = m + gain * (z - m), p * (1 - gain)
            out[key, day] = (*before, m, p)
    return out


def test_levels_against_the_filter_row_by_row(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(-200, 900), r.gauss(0, 1), r.choice([0.001, 0.5, 3.0])) for k in (1, 2, None) for _ in range(120)]
    odd = [(1, None, 1.0, 1.0), (1, 5, None, 1.0), (1, 5, 1.0, 0.0), (2, 6, 1.0, None)]
    frame = spark.createDataFrame(rows + odd, "key long, day long, z double, r double")
    got = {(x.key, x.day): tuple(x)[2:] for x in kalman.levels(frame, ["key"], "day", F.col("z"), F.col("r")).collect()}
    want = filtered(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)
    assert kalman.levels(frame.limit(0), ["key"], "day", F.col("z"), F.col("r")).count() == 0


def test_a_hot_key_is_one_row_a_day(spark):
    rows = spark.range(60_000).select(F.lit(7).alias("key"), (F.col("id") % 900).alias("day"), F.sin("id").alias("z"), F.lit(2.0).alias("r"))
    out = kalman.levels(rows, ["key"], "day", F.col("z"), F.col("r"))
    assert out.count() == 900
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan


def test_composing_blocks_of_any_size_gives_the_same(spark):
    r = random.Random(4)
    frame = spark.createDataFrame([(1, d, r.gauss(0, 1), 0.3) for d in range(300)], "key long, day long, z double, r double")
    a, b, c = ({x.day: tuple(x)[2:] for x in kalman.levels(frame, ["key"], "day", F.col("z"), F.col("r"), block=n).collect()} for n in (1, 7, 1000))
    for d in a:
        assert a[d] == pytest.approx(b[d], rel=1e-10, abs=1e-13) and a[d] == pytest.approx(c[d], rel=1e-10, abs=1e-13)


# replay -------------------------------------------------------------------------------------------

OBSERVED = "key long, ts_us long, id long, target double, a double, b double, voided boolean, shift double"


def observed(spark, rows):
    frame = spark.createDataFrame(rows, OBSERVED)
    return replay.observations(frame, ["a", "b"], voided=F.col("voided"), shift=F.col("shift"))


def test_the_better_member_gains(spark):
    rows = [(1, i, i, 1.0, 0.9, 0.4, False, 0.0) for i in range(60)]
    out = {r.id: r for r in replay.replayed(observed(spark, rows), ["a", "b"]).collect()}
    assert out[59].a > 0.9 and out[59].b >= 0.03 and out[59].a + out[59].b == pytest.approx(1)
    assert out[59].blend_loss <= out[59].champion_loss + 0.05


def test_refused_rows_teach_nothing(spark):
    rows = [(1, 1, 1, 1.0, 0.9, 0.4, True, 0.0), (1, 2, 2, 1.0, None, 0.4, False, 0.0), (1, 3, 3, None, 0.9, 0.4, False, 0.0), (1, 4, 4, 1.0, float("nan"), 0.4, False, 0.0), (1, 5, 5, 1.0, float("inf"), 0.4, False, 0.0), (1, 6, 6, 1.0, 0.9, 0.4, None, -0.4), (1, 7, 7, 0.0, 1.4, -0.3, False, None)]
    out = {r.id: r for r in replay.replayed(observed(spark, rows), ["a", "b"]).collect()}
    assert [out[i].kind for i in range(1, 8)] == ["void", *["data error"] * 4, "market move", "healthy"]
    assert [out[i].used for i in range(1, 8)] == [0, 0, 0, 0, 0, 1, 2] and out[5].a == 0.5 and out[5].blend is None
    assert out[7].champion_loss == pytest.approx(min((0.1**2 + 1) / 2, 0.6**2 / 2))  # forecasts out of range are clamped


def test_a_sustained_loss_rolls_back_to_the_checkpoint(spark):
    good = [(1, i, i, 1.0, 0.95, 0.9, False, 0.0) for i in range(50)]
    bad = [(1, i, i, 0.0, 0.95, 0.9, False, 0.0) for i in range(50, 80)]
    out = {r.id: r for r in replay.replayed(observed(spark, good + bad), ["a", "b"]).collect()}
    first = next(i for i in sorted(out) if out[i].kind == "model drift")
    assert first >= 50 and (out[first].a, out[first].b) == (out[49].a, out[49].b) and out[first].rollbacks == 1 and out[first].version == 2
    none = [(1, i, i, float(i < 12), 0.95, 0.9, False, 0.0) for i in range(24)]  # before any checkpoint: equal weights again
    out = {r.id: r for r in replay.replayed(observed(spark, none), ["a", "b"]).collect()}
    first = next(i for i in sorted(out) if out[i].kind == "model drift")
    assert out[first].a == out[first].b == 0.5


def test_the_latest_state_of_each_key(spark):
    r = random.Random(1)
    rows = [(k, 1000 - i if k == 2 else i, i, float(r.random() < 0.5), r.random(), 0.5, False, 0.0) for k in (1, 2, None) for i in range(90)]
    seen = observed(spark, rows)
    told = replay.replayed(seen, ["a", "b"])
    last = {x.key: x for x in replay.latest(told, seen).collect()}
    assert set(last) == {1, 2} and last[1].id == 89 and last[2].id == 0 and last[1].used == 90  # a null key has no state to look up


def test_the_learner_can_be_written_and_read():
    s, r = replay.Learner(3), random.Random(2)
    for _ in range(130):
        s.learn([r.random() for _ in range(3)], float(r.random() < 0.5))
    t = replay.Learner(3).read(s.numbers())
    assert vars(s) == vars(t) and s.saved
    for _ in range(60):
        p, y = [r.random() for _ in range(3)], float(r.random() < 0.5)
        assert s.learn(p, y) == t.learn(p, y)
    assert vars(s) == vars(t)


def test_a_stream_replays_like_a_batch(spark, tmp_path):
    r = random.Random(7)
    rows = [(k, 10 * i, 1000 * k + i, float(r.random() < 0.3 + 0.4 * (i > 60)), r.random(), 0.3, i % 17 == 0, 0.0) for i in range(120) for k in (1, 2, 3)]
    frame = spark.createDataFrame(rows, OBSERVED)
    landing = tmp_path / "landing"
    for part in range(4):  # files in order of time, one micro-batch each
        frame.where(F.col("ts_us").between(300 * part, 300 * part + 299)).coalesce(1).write.mode("append").json(str(landing))
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).json(str(landing))
    out = streamed.replayed(replay.observations(stream, ["a", "b"], voided=F.col("voided"), shift=F.col("shift")), ["a", "b"])
    query = out.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {x.id: tuple(x) for x in spark.table("replayed").collect()}
    want = {x.id: tuple(x) for x in replay.replayed(observed(spark, rows), ["a", "b"]).collect()}
    assert len(query.recentProgress) >= 4 and any(x[2] == "model drift" for x in want.values())
    assert got == want


def test_late_rows_of_a_stream_teach_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    for part, times in enumerate([[10, 30], [20, 40]]):
        rows = [(1, t, t, 1.0, 0.9, 0.4, False, 0.0) for t in times]
        spark.createDataFrame(rows, OBSERVED).coalesce(1).write.mode("append").json(str(landing))
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).json(str(landing))
    out = streamed.replayed(replay.observations(stream, ["a", "b"]), ["a", "b"])
    query = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {x.id: x for x in spark.table("late").collect()}
    assert got[20].kind == "late" and got[40].used == 3


def test_the_anchor_learns_whom_to_trust(spark):
    schema = "key long, ts_us long, id long, y double, model double, market double"
    right = [(1, i, i, float(i % 2), 0.9 if i % 2 else 0.1, 0.5) for i in range(200)]
    wrong = [(2, i, i, float(i % 2), 0.1 if i % 2 else 0.9, 0.5) for i in range(200)]
    odd = [(1, 999, 900, 1.0, 1.5, 0.5), (1, 999, 901, 1.0, 0.5, 1.0), (1, 999, 902, 1.0, None, 0.5), (1, 999, 903, None, 0.5, 0.5), (1, 999, 904, 1.0, float("nan"), 0.5)]
    out = {(r.key, r.id): r for r in replay.anchored(spark.createDataFrame(right + wrong + odd, schema)).collect()}
    assert len(out) == 400 and out[1, 28].share == 0.55 and out[1, 199].share > 0.85 and out[2, 199].share < 0.45
    assert out[1, 199].loss < out[1, 199].market_loss < out[2, 199].loss


# shots --------------------------------------------------------------------------------------------

SHOTS = "league string, day long, id long, home string, away string, home_n int, away_n int, home_shots int, away_shots int, judge string, top boolean"


def shot_history(spark, days=40, judge="J", extra=()):
    from tideline.operators import shots

    rows = []
    for k in range(days):
        rows.append(("E", 7 * k, 2 * k, "city", "mid", 10, 4, 20, 8, judge, True))
        rows.append(("E", 7 * k, 2 * k + 1, "rovers", "other", 2, 3, 7, 9, "K", True))
    return {r.id: r for r in shots.two_stage(spark.createDataFrame([*rows, *extra], SHOTS)).collect()}


def test_two_stages_separate_shots_from_what_comes_of_them(spark):
    end = 7 * 39
    ask = lambda i, day, home, away, judge=None: ("E", day, i, home, away, None, None, None, None, judge, True)
    out = shot_history(spark, extra=[ask(900, end + 3, "city", "mid"), ask(901, end + 3, "rovers", "other"), ask(902, end + 300, "city", "mid"), ask(903, end + 3, "city", "nobody"), ask(904, end + 3, "city", "mid", "J"), ask(905, end + 3, "city", "mid", "new")])
    assert out[900].home_mean > out[901].home_mean and out[902].home_mean < out[900].home_mean and out[903].home_mean is None and out[0].home_mean is None
    assert out[900].team_matches == 40 and out[900].log_variance == pytest.approx(0.036 * (1 - 40 / 48 * 0.85))
    assert out[904].home_mean > out[900].home_mean == out[905].home_mean  # the judge of many counts


def test_two_stages_do_not_see_their_own_day_nor_rows_without_shots(spark):
    last = [("E", 500, 950, "city", "mid", 5, 5, 10, 10, "J", True), ("E", 500, 951, "city", "mid", 9, 9, 30, 1, "J", True), ("E", 501, 952, "city", "mid", 9, 9, None, 1, "J", True), ("E", 501, 953, "city", "mid", 9, 9, 0, 1, "J", True), ("E", 502, 954, "city", "mid", None, None, None, None, "J", True), (None, 1, 955, "a", "b", 1, 1, 1, 1, None, True), ("E", 503, 956, None, "mid", 1, 1, 1, 1, None, True)]
    out = shot_history(spark, extra=last)
    assert out[950][1:] == out[951][1:] and out[952][1:] == out[953][1:] and out[954].team_matches == 42
    assert out[955].home_mean is None and out[956].home_mean is None


def test_counts_against_tight_defences_weigh_more(spark):
    from tideline.operators import shots

    rows = [(k, k, "E0", "tight", "a", 5, 1) for k in range(30)] + [(100 + k, k, "E0", "leaky", "b", 5, 9) for k in range(30)] + [(200, 50, "E0", "x", "tight", 6, 1), (201, 50, "E0", "y", "leaky", 6, 1), (202, 60, "E0", "x", "y", 0, 0), (203, 70, "E1", "z", "w", 1, 1)]
    out = {(r.id, r.team): r for r in shots.adjusted(spark.createDataFrame(rows, "id long, day long, division string, home string, away string, home_n int, away_n int")).collect()}
    assert out[200, "x"].scale == 1.4 and out[201, "y"].scale == 0.7 and out[202, "x"].adjusted == pytest.approx(6 * 1.4) and out[202, "y"].adjusted == pytest.approx(6 * 0.7)
    assert out[0, "tight"].scale == 1.0 and len(out) == 2 * len(rows) and out[203, "z"].adjusted > 0


def test_the_quality_of_shots(spark):
    from tideline.operators import shots

    rows = spark.createDataFrame([(10, 4), (3, 5), (None, 1), (2, None)], "s int, t int")
    got = [r[0] for r in rows.select(shots.quality(F.col("s"), F.col("t"))).collect()]
    assert got[0] == pytest.approx(0.32 * 4 + 0.09 * 6) and got[1] == pytest.approx(1.6) and got[2:] == [None, None]
