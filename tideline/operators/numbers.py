"""Nine models of drawn numbers, each draw scored from the draws before it, in linear time.

What the models count (numbers, followers, repeats at a lag, turnovers) adds up, so draws are cut into blocks:
each block's counts are added up by themselves, a running sum over the blocks gives every block what was
known when it began, and then all blocks score their draws at the same time, one after another within a
block, with the few hundred draws before it at hand. The correction of the models' weights by their own past
success runs over draws in order, but comes to rest: which weights follow which does not depend on the draws, and
after some hundred corrections the next ones are the same to the last digit. From there on, blocks guess by themselves.

A draw has an index (numbered()), up to six distinct numbers of 1 to 49, a weekday or none, and a turnover.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

NUMBERS, PICKS = 49, 6

#: The models' weights, of which the first four correct themselves; draws before the first scored one; windows; lags.
WEIGHTS = {"freq": 0.35, "markov": 0.25, "gap": 0.25, "bias": 0.15, "prime": 0.06, "sums": 0.06, "day": 0.04, "turnover": 0.04, "period": 0.02}
LEAST, RECENT, STRUCTURE, BUSY = 100, 200, 300, 20
LAGS = range(3, 31)
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]

BLOCK = 512
#: Draws of a block where only guesses are asked for; draws at a time that it works out; draws at first in order until the weights settle.
LONG, AT_ONCE, IN_ORDER = 8192, 512, 1 << 14
MODELS = list(WEIGHTS)

#: Where a block's sums lie in one vector: counts, followers, repeats by lag, turnovers (number, sum, squares).
AT = np.cumsum([0, NUMBERS, NUMBERS * NUMBERS, len(LAGS) * NUMBERS, 3])


def numbered(draws: DataFrame, order: str, parts: int = 1000) -> DataFrame:
    """draws with i, their place in order from 0: counts over ranges of the order first, then places within a range."""
    low, high = draws.agg(F.min(order), F.max(order)).first()
    if low is None:
        return draws.withColumn("i", F.lit(None).cast("long"))
    width = max(1, -(-(high - low + 1) // parts))
    rows = draws.withColumn("__r", F.floor((F.col(order) - low) / width))
    sizes = rows.groupBy("__r").agg(F.count("*").alias("__c"))  # `parts` rows
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__r").orderBy(order))
    return rows.join(F.broadcast(sizes.select("__r", before.alias("__b"))), "__r").withColumn("i", (F.col("__b") + place - 1).cast("long")).drop("__r", "__b")


def compact(draws: DataFrame) -> DataFrame:
    """i, mask, dated, turnover of draws: a draw's numbers as the bits of one long."""
    if "mask" in draws.columns:
        return draws
    mask = F.aggregate("numbers", F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (n - 1).cast("int"))))
    return draws.select("i", mask.alias("mask"), F.col("weekday").isNotNull().alias("dated"), F.coalesce(F.col("turnover").cast("double"), F.lit(0.0)).alias("turnover"))


def _marks(masks: pd.Series) -> np.ndarray:
    return (masks.to_numpy(dtype=np.int64)[:, None] >> np.arange(NUMBERS) & 1).astype(float)


def _added(g: pd.DataFrame, block: int, size: int, centre: float) -> np.ndarray:
    """What a block's own draws add to the sums, seen with the draws before them."""
    marks, own = _marks(g["mask"]), (g["i"] >= block * size).to_numpy()
    first = int(np.argmax(own))
    out = np.zeros(AT[-1])
    out[AT[0] : AT[1]] = marks[first:].sum(axis=0)
    after = max(first, 1)
    out[AT[1] : AT[2]] = (marks[after - 1 : -1].T @ marks[after:]).ravel()
    for n, lag in enumerate(LAGS):
        begin = max(first, lag)
        if begin < len(marks):
            out[AT[2] + n * NUMBERS : AT[2] + (n + 1) * NUMBERS] = (marks[begin:] * marks[begin - lag : len(marks) - lag]).sum(axis=0)
    t = g["turnover"].to_numpy(dtype=float)[first:]
    t = t[t > 0] - centre
    out[AT[3] :] = len(t), t.sum(), (t * t).sum()
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def probabilities(n: int, sums: np.ndarray, seen: np.ndarray, marks: np.ndarray, dated: np.ndarray, turnover: np.ndarray, centre: float) -> dict[str, np.ndarray]:
    """Each model's chances of the 49 numbers after n draws. seen: the index of each number's last draw (-1: none); marks, dated, turnover: of the last RECENT draws."""
    count = sums[AT[0] : AT[1]]
    freq = _normal(count + 1)
    last = marks[-1].astype(bool)
    follow = sums[AT[1] : AT[2]].reshape(NUMBERS, NUMBERS)
    out = {"freq": freq, "markov": _normal(1 + (1 + follow[last]).sum(axis=0))}
    gap = np.where(seen >= 0, n - 1 - seen, n)
    out["gap"] = _normal(freq * (1 + gap / n * 0.5))
    z = (count - n * 6 / 49) / (n * (6 / 49) * (43 / 49))
    most = np.abs(z).max()
    out["bias"] = _normal(1 / (1 + np.exp(-z / (most * 0.5)))) if n >= 100 and most > 0 else np.zeros(NUMBERS)
    out["prime"] = _normal((count + 1) * np.where(np.isin(np.arange(1, NUMBERS + 1), PRIMES), 0.95, 1.0))
    mean = (marks @ np.arange(1, NUMBERS + 1)).mean()
    out["sums"] = _normal(1 + 0.5 * (1 - np.abs(np.arange(1, NUMBERS + 1) - mean / 6) / 49))
    out["day"] = _normal(1 + marks[dated].sum(axis=0) / 50)
    m, total, squares = sums[AT[3] :]
    busy = np.ones(NUMBERS)
    mean, var = (total / m, squares / m - (total / m) ** 2) if m else (0.0, 0.0)
    if m >= 20 and var > 1e-9 * max(1.0, mean * mean):
        for k in range(len(marks) - 1, max(-1, len(marks) - 1 - BUSY), -1):
            high = (turnover[k] - centre - mean) / np.sqrt(var)
            if turnover[k] > 0 and high > 1.5:
                busy = np.where(marks[k] > 0, busy * (1 + high / 20), busy)
        out["turnover"] = _normal(busy)
    else:
        out["turnover"] = np.zeros(NUMBERS)
    out["period"] = _normal(1 / NUMBERS + rhythm(n, sums) * 0.02)
    return out


def rhythm(n: int, sums: np.ndarray) -> np.ndarray:
    """0 to 1: how far a number's repeats at its best lag go beyond chance."""
    if n < 100:
        return np.zeros(NUMBERS)
    repeats = sums[AT[2] : AT[3]].reshape(len(LAGS), NUMBERS)
    return np.clip((np.maximum((repeats / (n - np.array(LAGS))[:, None]).max(axis=0), 0) - 0.015) * 40, 0, 1)


def structures(marks: np.ndarray) -> np.ndarray:
    """Of each draw how many numbers are odd, how many above 24, and the class of their sum."""
    n = np.arange(1, NUMBERS + 1)
    return np.stack([marks[:, n % 2 == 1].sum(axis=1), marks[:, n > 24].sum(axis=1), np.digitize(marks @ n, [100, 140, 180])], axis=1).astype(int)


def by_structure(base: np.ndarray, kinds: np.ndarray) -> tuple[list[int], int]:
    """Six numbers, and a seventh, by falling chance, that keep to the commonest structure of some draws (of equals the one that came up last)."""
    best = []
    for k in range(3):
        values, first, times = np.unique(kinds[:, k], return_index=True, return_counts=True)
        most = times == times.max()
        best.append(int(values[most][first[most].argmax()]))
    odd, big, top = best[0], best[1], (99, 139, 179, 250)[best[2]]
    order = np.lexsort((np.arange(NUMBERS), -base)) + 1
    taken: list[int] = []
    odds = bigs = total = 0
    for v in order.tolist():
        full = odds >= odd if v % 2 else len(taken) - odds >= PICKS - odd
        full = full or (bigs >= big if v > 24 else len(taken) - bigs >= PICKS - big)
        if len(taken) < PICKS and not full and not (total + v > top and len(taken) >= 4):
            taken.append(v)
            odds, bigs, total = odds + v % 2, bigs + (v > 24), total + v
    return sorted(taken), next(v for v in order.tolist() if v not in taken)


def _known(draws: DataFrame, size: int) -> tuple[DataFrame, DataFrame, float]:
    """The draws with their block, also those that the next block looks back to; what was known when each block began; the mean turnover.

    Blocks are dealt out over as many tasks as there are blocks: they are few rows, but much work.
    """
    d = compact(draws)
    mean, most = d.agg(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))), F.max("i")).first()
    centre, tasks = mean or 0.0, min((most or 0) // size + 1, 4096)
    block = F.floor(F.col("i") / size).cast("long")
    # a draw belongs to its block, and to the next one if it is among the last before it
    near = F.when(F.col("i") % size >= size - STRUCTURE, F.array(block, block + 1)).otherwise(F.array(block))
    placed = d.withColumn("block", F.explode(near)).repartition(tasks, "block")

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        if not (g["i"] >= key[0] * size).any():
            return pd.DataFrame({"block": [], "at": [], "x": [], "seen": []})
        last = np.where(_marks(g["mask"]) > 0, g["i"].to_numpy()[:, None], -1).max(axis=0)
        sums = _added(g, key[0], size, centre)
        return pd.DataFrame({"block": key[0], "at": np.arange(AT[-1] + NUMBERS), "x": np.concatenate([sums, np.zeros(NUMBERS)]), "seen": np.concatenate([np.full(AT[-1], -1), last])})

    added = placed.groupBy("block").applyInPandas(add, "block long, at long, x double, seen long")  # some thousands of rows a block
    run = Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = added.select("block", "at", F.coalesce(F.sum("x").over(run), F.lit(0.0)).alias("x"), F.coalesce(F.max("seen").over(run), F.lit(-1)).alias("seen")).where("x <> 0 or seen >= 0").repartition(tasks, "block")
    return placed, before, centre


def scored(draws: DataFrame, least: int = LEAST, size: int = BLOCK) -> DataFrame:
    """i, numbers, last, the nine models' chances (arrays of 49), pattern and pattern_special of every draw from the least-th on, each from the draws before it.

    draws: i, numbers, weekday, turnover; see numbered().
    """
    if size < STRUCTURE:
        raise ValueError(f"a block holds at least {STRUCTURE} draws")
    placed, before, centre = _known(draws, size)

    def score(key: tuple, g: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        sums, seen = np.zeros(AT[-1]), np.full(NUMBERS, -1)
        small = start["at"] < AT[-1]
        sums[start["at"][small].to_numpy(dtype=int)] = start["x"][small]
        seen[start["at"][~small].to_numpy(dtype=int) - AT[-1]] = start["seen"][~small]
        marks, index = _marks(g["mask"]), g["i"].to_numpy()
        kinds = structures(marks)
        dated, turnover, numbers = g["dated"].to_numpy(dtype=bool), g["turnover"].to_numpy(dtype=float), [np.flatnonzero(m) + 1 for m in marks]
        out = []
        for k in range(int(np.argmax(index >= key[0] * size)) if (index >= key[0] * size).any() else len(g), len(g)):
            n = int(index[k])
            if n >= least:
                low = max(0, k - RECENT)
                p = probabilities(n, sums, seen, marks[low:k], dated[low:k], turnover[low:k], centre)
                pattern, special = by_structure(p["freq"] * (1 + rhythm(n, sums) * 2), kinds[max(0, k - STRUCTURE) : k])
                out.append((n, list(map(int, numbers[k])), list(map(int, numbers[k - 1])), *(p[m].tolist() for m in MODELS), pattern, special))
            sums[AT[0] : AT[1]] += marks[k]
            if k:
                sums[AT[1] : AT[2]] += np.outer(marks[k - 1], marks[k]).ravel()
            lags = np.array([lag for lag in LAGS if lag <= k], dtype=int)
            sums[AT[2] : AT[2] + len(lags) * NUMBERS] += (marks[k] * marks[k - lags]).ravel()
            if turnover[k] > 0:
                sums[AT[3] :] += 1, turnover[k] - centre, (turnover[k] - centre) ** 2
            seen[marks[k] > 0] = n
        return pd.DataFrame(out, columns=["i", "numbers", "last", *MODELS, "pattern", "pattern_special"])

    schema = "i long, numbers array<int>, last array<int>, " + ", ".join(f"{m} array<double>" for m in MODELS) + ", pattern array<int>, pattern_special int"
    return placed.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(score, schema)


def blended(p: dict[str, np.ndarray], weights: dict[str, float], last: list[int]) -> np.ndarray:
    """The models' chances by their weights; numbers of the last draw, and runs of three likely ones, count less."""
    x = sum(w * np.asarray(p[m]) for m, w in weights.items())
    x[np.asarray(last, dtype=int) - 1] *= 0.85
    for n in range(NUMBERS - 2):
        if (x[n : n + 3] > 0.02).all():
            x[n : n + 3] *= 0.7
    return x


def picked(x: np.ndarray) -> tuple[list[int], int, float]:
    """The six likeliest numbers, the seventh, and by how much the six lead in percent points; of equals the smaller number."""
    order = sorted(range(1, NUMBERS + 1), key=lambda n: (-x[n - 1], n))
    best = sorted(order[:PICKS])
    return best, order[PICKS], float(np.clip((x[np.array(best) - 1].mean() - x.mean()) * 100, 0, 100))


def chances(index: np.ndarray, own: slice, sums: np.ndarray, seen: np.ndarray, marks: np.ndarray, dated: np.ndarray, turnover: np.ndarray, centre: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """probabilities() of all draws of own at once, each from those before it; and sums and seen after them. A row a draw."""
    mine, n, r = marks[own], index[own, None].astype(float), np.arange(own.start, own.stop)
    so_far = lambda start, x: np.cumsum(np.concatenate([np.broadcast_to(start, x.shape[1:])[None], x]), axis=0)
    counts = so_far(sums[AT[0] : AT[1]], mine)
    count, sums = counts[:-1], sums.copy()
    before = np.concatenate([np.zeros((1, NUMBERS)), marks])[own]  # the draw before each
    even = lambda x: x / x.sum(axis=1, keepdims=True)
    freq = even(count + 1)
    follow = before @ sums[AT[1] : AT[2]].reshape(NUMBERS, NUMBERS) + np.tril(before @ before.T, -1) @ mine
    out = {"freq": freq, "markov": even(1 + (before.sum(axis=1, keepdims=True) + follow))}
    lasts = np.maximum.accumulate(np.concatenate([seen[None], np.where(mine > 0, index[own, None], -1)]), axis=0)
    gap = np.where(lasts[:-1] >= 0, n - 1 - lasts[:-1], n)
    out["gap"] = even(freq * (1 + gap / n * 0.5))
    z = (count - n * 6 / 49) / (n * (6 / 49) * (43 / 49))
    most = np.abs(z).max(axis=1, keepdims=True)
    told = (n >= 100) & (most > 0)
    out["bias"] = np.where(told, even(1 / (1 + np.exp(-z / (np.where(told, most, 1.0) * 0.5)))), 0.0)
    out["prime"] = even((count + 1) * np.where(np.isin(np.arange(1, NUMBERS + 1), PRIMES), 0.95, 1.0))
    low = np.maximum(0, r - RECENT)
    totals = so_far(0.0, (marks @ np.arange(1, NUMBERS + 1))[:, None])
    mean = (totals[r] - totals[low]) / (r - low)[:, None]
    out["sums"] = even(1 + 0.5 * (1 - np.abs(np.arange(1, NUMBERS + 1) - mean / 6) / 49))
    days = so_far(0.0, marks * dated[:, None])
    out["day"] = even(1 + (days[r] - days[low]) / 50)
    t = turnover[own]
    t = np.stack([t > 0, np.where(t > 0, t - centre, 0), np.where(t > 0, (t - centre) ** 2, 0)], axis=1)
    money = so_far(sums[AT[3] :], t)
    m, total, squares = (money[:-1, [k]] for k in range(3))
    some = np.maximum(m, 1)
    mean, var = total / some, squares / some - (total / some) ** 2
    told = (m >= 20) & (var > 1e-9 * np.maximum(1.0, mean * mean))
    busy, spread = np.ones(mine.shape), np.sqrt(np.where(told, var, 1.0))
    for back in range(1, BUSY + 1):
        k = np.maximum(r - back, 0)
        high = (turnover[k, None] - centre - mean) / spread
        more = (r - back >= 0)[:, None] & (turnover[k, None] > 0) & (high > 1.5) & (marks[k] > 0)
        busy = np.where(more, busy * (1 + high / 20), busy)
    out["turnover"] = np.where(told, even(busy), 0.0)
    best = np.full(mine.shape, -np.inf)
    for at, lag in zip(range(AT[2], AT[3], NUMBERS), LAGS, strict=True):
        again = np.where((r >= lag)[:, None], mine * marks[np.maximum(r - lag, 0)], 0.0)
        repeats = so_far(sums[at : at + NUMBERS], again)
        best = np.maximum(best, repeats[:-1] / np.maximum(n - lag, 1))
        sums[at : at + NUMBERS] = repeats[-1]
    beyond = np.where(n >= 100, np.clip((np.maximum(best, 0) - 0.015) * 40, 0, 1), 0.0)
    out["period"] = even(1 / NUMBERS + beyond * 0.02)
    sums[AT[0] : AT[1]], sums[AT[3] :] = counts[-1], money[-1]
    sums[AT[1] : AT[2]] += (before.T @ mine).ravel()
    return out, sums, lasts[-1]


def guessed(draws: DataFrame, weights: dict[str, float], least: int = LEAST, size: int = LONG, first: int = 0) -> DataFrame:
    """i, picks, special, confidence, matches, block, within of every draw from the least-th on in the blocks from first on, by weights that stay.

    within: the rolling share of matches as if it began with the block. Each block also tells the next, in a row without i,
    how its own has ended.
    """
    if size < STRUCTURE:
        raise ValueError(f"a block holds at least {STRUCTURE} draws")
    placed, before, centre = _known(draws, size)
    names = ["i", "picks", "special", "confidence", "matches", "block", "within"]

    def guess(key: tuple, g: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        index = g["i"].to_numpy()
        if not (index >= key[0] * size).any():
            return pd.DataFrame([], columns=names)
        sums, seen = np.zeros(AT[-1]), np.full(NUMBERS, -1)
        small = start["at"] < AT[-1]
        sums[start["at"][small].to_numpy(dtype=int)] = start["x"][small]
        seen[start["at"][~small].to_numpy(dtype=int) - AT[-1]] = start["seen"][~small]
        marks, dated, turnover = _marks(g["mask"]), g["dated"].to_numpy(dtype=bool), g["turnover"].to_numpy(dtype=float)
        rolling, out = 0.0, []
        begin = int(np.argmax(index >= key[0] * size))
        if begin == 0 and len(g):  # nothing lies before the first draw of all, from which none is guessed
            sums, seen = _after_first(sums, marks[0], turnover[0], centre), np.where(marks[0] > 0, index[0], seen)
            begin = 1
        for low in range(begin, len(g), AT_ONCE):
            own = slice(low, min(low + AT_ONCE, len(g)))
            p, sums, seen = chances(index, own, sums, seen, marks, dated, turnover, centre)
            picks, special, confidence = picked_at_once(blended_at_once(p, weights, marks[own.start - 1 : own.stop - 1] > 0))
            matches = np.take_along_axis(marks[own], picks - 1, axis=1).sum(axis=1).astype(int)
            for k in np.flatnonzero(index[own] >= least).tolist():
                rolling = 0.3 * int(matches[k]) / 6 + 0.7 * rolling
                out.append((int(index[own][k]), picks[k].tolist(), int(special[k]), float(confidence[k]), int(matches[k]), key[0], rolling))
        if out:
            out.append((None, None, None, None, None, key[0] + 1, rolling))
        return pd.DataFrame(out, columns=names).astype({"i": "Int64", "special": "Int32", "matches": "Int32"})

    schema = "i long, picks array<int>, special int, confidence double, matches int, block long, within double"
    mine, theirs = (x.where(F.col("block") >= first) if first else x for x in (placed, before))
    return mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInPandas(guess, schema)


def _after_first(sums: np.ndarray, marks: np.ndarray, turnover: float, centre: float) -> np.ndarray:
    out = sums.copy()
    out[AT[0] : AT[1]] += marks
    if turnover > 0:
        out[AT[3] :] += 1, turnover - centre, (turnover - centre) ** 2
    return out


def blended_at_once(p: dict[str, np.ndarray], weights: dict[str, float], last: np.ndarray) -> np.ndarray:
    """blended() of many draws, a row each; last: whether a number is in the draw before."""
    x = sum(w * p[m] for m, w in weights.items())
    x = np.where(last, x * 0.85, x)
    for n in range(NUMBERS - 2):
        run = (x[:, n : n + 3] > 0.02).all(axis=1)
        x[run, n : n + 3] *= 0.7
    return x


def picked_at_once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """picked() of many draws."""
    order = np.argsort(-x, axis=1, kind="stable")
    best = np.sort(order[:, :PICKS], axis=1)
    lead = (np.take_along_axis(x, best, axis=1).mean(axis=1) - x.mean(axis=1)) * 100
    return best + 1, order[:, PICKS] + 1, np.clip(lead, 0, 100)


def corrected(w: dict[str, float]) -> dict[str, float]:
    """The weights after a correction."""
    moved = {m: min(max(w[m] + by, 0.05), most) for m, by, most in (("freq", 0.05, 0.7), ("markov", -0.02, 0.7), ("gap", 0.02, 0.7), ("bias", -0.03, 0.4))}
    whole = sum(moved.values())
    return w | {m: v / whole for m, v in moved.items()}


def rolled(rows: DataFrame, weights: dict[str, float], least: int = LEAST, size: int = LONG) -> DataFrame:
    """backtest()'s columns of guessed() rows. Of the block before the last one nothing is left: 0.7 ** 300 is less than a double's last digit."""
    block = Window.partitionBy("block")
    before = F.coalesce(F.max(F.when(F.col("i").isNull(), F.col("within"))).over(block), F.lit(0.0))
    since = F.col("i") - F.greatest(F.col("block") * size, F.lit(least)) + 1
    rows = rows.withColumn("rolling", F.col("within") + before * F.pow(F.lit(0.7), since)).where("i is not null")
    return rows.select("i", "picks", "special", "confidence", "matches", "rolling", *[F.lit(weights[m]).alias(f"w_{m}") for m in MODELS[:4]])


def streamed(draws: DataFrame, least: int = LEAST) -> DataFrame:
    """backtest() of scored() draws, in one task that streams the draws, a bit mask each, and holds the sums and the last few hundred draws."""
    rows = compact(draws)
    centre = rows.where("turnover > 0").agg(F.avg("turnover")).first()[0] or 0.0
    kept = max(RECENT, STRUCTURE)
    names = ["i", "picks", "special", "confidence", "matches", "rolling", *[f"w_{m}" for m in MODELS[:4]]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, rolling, n, settled = dict(WEIGHTS), 0.0, 0, False
        sums, seen, old = np.zeros(AT[-1]), np.full(NUMBERS, -1), None
        for batch in batches:
            begin = 0 if old is None else len(old)
            g = batch if old is None else pd.concat([old, batch], ignore_index=True)
            index, marks, dated, turnover = g["i"].to_numpy(), _marks(g["mask"]), g["dated"].to_numpy(dtype=bool), g["turnover"].to_numpy(dtype=float)
            if old is None and len(g):
                sums, seen = _after_first(sums, marks[0], turnover[0], centre), np.where(marks[0] > 0, index[0], seen)
                begin = 1
            out: list[tuple] = []
            for low in range(begin, len(g), AT_ONCE):
                own = slice(low, min(low + AT_ONCE, len(g)))
                p, sums, seen = chances(index, own, sums, seen, marks, dated, turnover, centre)
                last, k = marks[own.start - 1 : own.stop - 1] > 0, int(np.argmax(index[own] >= least)) if index[own.stop - 1] >= least else own.stop - low
                while k < own.stop - low:  # once, and again after each correction
                    first = k
                    picks, special, confidence = picked_at_once(blended_at_once({m: x[first:] for m, x in p.items()}, w, last[first:]))
                    matches = np.take_along_axis(marks[own][first:], picks - 1, axis=1).sum(axis=1).astype(int)
                    moved = False
                    while k < own.stop - low and not moved:
                        j, before = k - first, rolling
                        rolling = 0.3 * int(matches[j]) / 6 + 0.7 * rolling
                        out.append((int(index[low + k]), picks[j].tolist(), int(special[j]), float(confidence[j]), int(matches[j]), rolling, *(w[m] for m in MODELS[:4])))
                        if not settled and rolling < before - 0.05 and n > 10:
                            now = corrected(w)
                            settled, moved, w = now == w, now != w, now
                        n, k = n + 1, k + 1
            old = g.iloc[-kept:]
            yield pd.DataFrame(out, columns=names)

    schema = "i long, picks array<int>, special int, confidence double, matches int, rolling double, " + ", ".join(f"w_{m} double" for m in MODELS[:4])
    return rows.withColumn("__all", F.lit(1)).repartition("__all").sortWithinPartitions("i").drop("__all").mapInPandas(run, schema)


def tested(draws: DataFrame, correcting: bool = True, least: int = LEAST, size: int = LONG, in_order: int = IN_ORDER) -> DataFrame:
    """backtest() of scored() draws, without a row of chances a draw.

    correcting: draws go in order until the weights have settled (twice as many as long as they have not, all if need be);
    the others are guessed block by block.
    """
    draws = compact(draws).persist()
    if not correcting:
        return rolled(guessed(draws, WEIGHTS, least, size), WEIGHTS, least, size)
    many, to = draws.count(), -(-max(in_order, 2 * least) // size) * size
    while to < many:
        early = streamed(draws.where(F.col("i") < to), least).persist()
        w = early.where(F.col("i") == to - 1).first()
        now = WEIGHTS | {m: w[f"w_{m}"] for m in MODELS[:4]}
        if corrected(now) == now:
            told = draws.sparkSession.createDataFrame([(None, None, None, None, None, to // size, w["rolling"])], "i long, picks array<int>, special int, confidence double, matches int, block long, within double")
            return early.unionByName(rolled(guessed(draws, now, least, size, to // size).unionByName(told), now, least, size))
        early.unpersist()
        to *= 2
    return streamed(draws, least)


def backtest(scores: DataFrame, correcting: bool = True) -> DataFrame:
    """i, picks, special, confidence, matches, rolling and the four weights that each draw was predicted by.

    correcting: a fall of the rolling share of matches by more than 0.05, after ten draws, moves the weights for the draws
    that follow; this runs over the draws in order. Otherwise the weights stay. For many draws see tested().
    """

    def begin() -> dict:
        return {"w": dict(WEIGHTS), "rolling": 0.0, "n": 0}

    def step(s: dict, r: Any) -> list[tuple]:
        w = s["w"]
        picks, special, confidence = picked(blended({m: getattr(r, m) for m in MODELS}, w, r.last))
        matches = len(set(picks) & {int(x) for x in r.numbers})
        rolling = 0.3 * matches / 6 + 0.7 * s["rolling"]
        told = (r.i, picks, special, confidence, matches, rolling, *(w[m] for m in MODELS[:4]))
        if correcting and rolling < s["rolling"] - 0.05 and s["n"] > 10:
            s["w"] = corrected(w)
        s["rolling"], s["n"] = rolling, s["n"] + 1
        return [told]

    schema = "i long, picks array<int>, special int, confidence double, matches int, rolling double, " + ", ".join(f"w_{m} double" for m in MODELS[:4])
    return fold(scores.withColumn("__all", F.lit(1)).select("__all", "i", "numbers", "last", *MODELS), ["__all"], ["i"], schema, begin, step)


def summary(tested: DataFrame) -> DataFrame:
    """One row: draws, mean matches, and the best draw with its matches; of equals the last."""
    best: Column = F.max(F.struct("matches", "i"))
    return tested.agg(F.count("*").alias("draws"), F.avg("matches").alias("mean_matches"), best["i"].alias("best"), best["matches"].alias("best_matches"))
