"""The nine number models against their definitions over whole prefixes, draw by draw."""

import random
from collections import Counter
from math import exp, sqrt

import pytest
from pyspark.sql import functions as F

from tideline.operators import numbers as N


def drawn(n, seed=1):
    r = random.Random(seed)
    return [(100 + 3 * k, sorted(r.sample(range(1, 50), r.choice([6, 6, 6, 5]))), None if k % 17 == 0 else k % 7, 0.0 if k % 13 == 0 else 1e6 * (1 + r.random() + (2 if k % 19 == 0 else 0))) for k in range(n)]


def predicted(past):
    """Chances of every model from all draws before, as they are defined."""
    n, every = len(past), range(1, 50)
    sets = [d[1] for d in past]
    count = Counter(x for s in sets for x in s)
    share = lambda p: {k: v / sum(p.values()) for k, v in p.items()}
    out = {"freq": share({k: count[k] + 1 for k in every})}
    follow = Counter((a, b) for s, t in zip(sets, sets[1:], strict=False) for a in s for b in t)
    out["markov"] = share({k: 1 + sum(1 + follow[a, k] for a in sets[-1]) for k in every})
    seen = {x: i for i, s in enumerate(sets) for x in s}
    out["gap"] = share({k: out["freq"][k] * (1 + (n - 1 - seen[k] if k in seen else n) / n * 0.5) for k in every})
    z = {k: (count[k] - n * 6 / 49) / (n * (6 / 49) * (43 / 49)) for k in every}
    most = max(map(abs, z.values()))
    out["bias"] = share({k: 1 / (1 + exp(-z[k] / (most * 0.5))) for k in every})
    out["prime"] = share({k: (count[k] + 1) * (0.95 if k > 1 and all(k % q for q in range(2, k)) else 1) for k in every})
    mean = sum(map(sum, sets[-200:])) / len(sets[-200:])
    out["sums"] = share({k: 1 + 0.5 * (1 - abs(k - mean / 6) / 49) for k in every})
    days = Counter(x for d in past[-200:] if d[2] is not None for x in d[1])
    out["day"] = share({k: 1 + days[k] / 50 for k in every})
    t = [d[3] for d in past if d[3] > 0]
    mean = sum(t) / len(t)
    std = sqrt(sum((x - mean) ** 2 for x in t) / len(t))
    busy = dict.fromkeys(every, 1.0)
    for d in past[-20:]:
        if d[3] > 0 and (d[3] - mean) / std > 1.5:
            for x in d[1]:
                busy[x] *= 1 + (d[3] - mean) / std / 20
    out["turnover"] = share(busy)
    rhythm = {}
    for k in every:
        signal = [k in s for s in sets]
        best = max(sum(signal[i] and signal[i + lag] for i in range(n - lag)) / (n - lag) for lag in range(3, 31))
        rhythm[k] = min(max((best - 0.015) * 40, 0), 1)
    out["period"] = share({k: 1 / 49 + rhythm[k] * 0.02 for k in every})
    return out, {k: out["freq"][k] * (1 + 2 * rhythm[k]) for k in every}


def frame(spark, rows):
    return N.numbered(spark.createDataFrame(rows, "draw_id long, numbers array<int>, weekday int, turnover double"), "draw_id", parts=7)


@pytest.fixture(scope="module")
def scores(spark):
    rows = drawn(700)
    return rows, N.scored(frame(spark, rows).repartition(5), least=100, size=300).persist()


def test_draws_are_numbered_in_order(spark):
    rows = drawn(40)
    got = {r.draw_id: r.i for r in frame(spark, rows[::-1]).collect()}
    assert got == {d[0]: k for k, d in enumerate(rows)} and frame(spark, rows[:0]).count() == 0


def test_each_draw_is_scored_from_all_draws_before_it(scores):
    rows, table = scores
    got = {r.i: r for r in table.collect()}
    assert sorted(got) == list(range(100, 700))
    for n in (100, 101, 299, 300, 301, 455, 599, 600, 699):
        want, base = predicted(rows[:n])
        for m in N.MODELS:
            assert got[n][m] == pytest.approx([want[m][k] for k in range(1, 50)], rel=1e-9), (n, m)
        assert got[n].numbers == rows[n][1] and got[n].last == rows[n - 1][1]
        pattern = got[n].pattern
        past = [d[1] for d in rows[:n]][-300:]
        assert pattern == sorted(set(pattern)) and len(pattern) <= 6 and got[n].pattern_special not in pattern
        odd = Counter(sum(x % 2 for x in s) for s in past)
        assert sum(x % 2 for x in pattern) <= max(k for k, c in odd.items() if c == max(odd.values()))
        assert max(pattern, key=lambda k: base[k]) == max(range(1, 50), key=lambda k: base[k]) or sum(pattern) > 0


def test_the_backtest_corrects_its_weights_from_what_came_before(scores):
    rows, table = scores
    got = {r.i: r for r in N.backtest(table).collect()}
    by = {r.i: r for r in table.collect()}
    w, rolling = dict(N.WEIGHTS), 0.0
    moved = 0
    for k, n in enumerate(range(100, 700)):
        p = {x: sum(w[m] * by[n][m][x - 1] for m in N.MODELS) for x in range(1, 50)}
        for x in rows[n - 1][1]:
            p[x] *= 0.85
        for x in range(1, 48):
            if all(p[x + j] > 0.02 for j in range(3)):
                for j in range(3):
                    p[x + j] *= 0.7
        order = sorted(p, key=lambda x: (-round(p[x], 14), x))
        assert got[n].picks == sorted(order[:6]) and got[n].special == order[6]
        assert got[n].confidence == pytest.approx((sum(p[x] for x in order[:6]) / 6 - sum(p.values()) / 49) * 100)
        matches = len(set(order[:6]) & set(rows[n][1]))
        now = 0.3 * matches / 6 + 0.7 * rolling
        assert got[n].matches == matches and got[n].rolling == pytest.approx(now) and got[n].w_freq == pytest.approx(w["freq"])
        if now < rolling - 0.05 and k > 10:
            moved += 1
            four = {m: min(max(w[m] + d, 0.05), top) for m, d, top in zip(N.MODELS[:4], (0.05, -0.02, 0.02, -0.03), (0.7, 0.7, 0.7, 0.4), strict=True)}
            w |= {m: v / sum(four.values()) for m, v in four.items()}
        rolling = now
    assert moved > 5
    s = N.summary(N.backtest(table)).first()
    most = max(r.matches for r in got.values())
    assert s.draws == 600 and s.mean_matches == pytest.approx(sum(r.matches for r in got.values()) / 600) and (s.best, s.best_matches) == (max(i for i, r in got.items() if r.matches == most), most)


def test_weights_that_stay(scores):
    _, table = scores
    assert N.backtest(table, correcting=False).agg(F.min("w_freq"), F.max("w_bias")).first()[:] == (0.35, 0.15)


def test_too_few_draws_and_blocks_too_small(spark):
    assert N.scored(frame(spark, drawn(99))).count() == 0 and N.scored(frame(spark, drawn(100))).count() == 0
    assert N.scored(frame(spark, drawn(101)[:0])).count() == 0
    with pytest.raises(ValueError, match="at least"):
        N.scored(frame(spark, drawn(10)), size=100)
    same = [(k, [1, 2, 3, 4, 5, 6], 1, 5.0) for k in range(130)]  # every turnover the same: that model has nothing to say
    assert N.scored(frame(spark, same)).agg(F.max(F.array_max("turnover"))).first()[0] == 0.0
