"""Learners that are replayed over settled forecasts, with checkpoints and rollback.

A learner weighs the members of an ensemble by their losses (Hedge, with a floor). A rising loss of the
blend (Page-Hinkley), or a blend that keeps losing to its best member (CUSUM), rolls the weights back to
the last checkpoint, or to equal ones without any; a checkpoint is taken every so many rows if the mean
loss has fallen since the last. The state of a key is some twenty numbers: in a batch an ordered fold
carries it from row to row, in a stream it is kept between micro-batches (streaming/replay.py), by the
same steps.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import event_kind
from .folds import floored, fold

#: Shares of the model's own view that the anchor weighs, and the share used until there are enough rows.
ANCHORS, DEFAULT_ANCHOR, LEAST_ANCHOR = (0.25, 0.55, 0.85, 1.0), 0.55, 30


def loss(p: float, y: float) -> float:
    return (min(max(p, 0.0), 1.0) - min(max(y, 0.0), 1.0)) ** 2


class Learner:
    """The state of one key. It can be written as a list of numbers and read again."""

    def __init__(self, members: int, every: int = 25, rate: float = 0.6, floor: float = 0.03, delta: float = 0.005, rise: float = 0.35, slack: float = 0.004, behind: float = 0.25, least: int = 20) -> None:
        self.members, self.every, self.rate, self.floor = members, every, rate, floor
        self.delta, self.rise, self.slack, self.behind, self.least = delta, rise, slack, behind, least
        self.weights = [1 / members] * members
        self.saved: list[float] = []  # the last checkpoint's weights
        self.saved_loss = 0.0
        self.version, self.rollbacks, self.used, self.blend_loss = 1, 0, 0, 0.0
        self.losses = [0.0] * members
        self.calm()

    def calm(self) -> None:
        """Both tests begin again."""
        self.n, self.mean, self.total, self.low, self.m, self.up = 0, 0.0, 0.0, 0.0, 0, 0.0

    def numbers(self) -> list[float]:
        head = [self.saved_loss, self.version, self.rollbacks, self.used, self.blend_loss, self.n, self.mean, self.total, self.low, self.m, self.up]
        return [float(x) for x in (*head, *self.weights, *self.losses, *self.saved)]

    def read(self, x: list[float]) -> Learner:
        self.saved_loss, version, rollbacks, used, self.blend_loss, n, self.mean, self.total, self.low, m, self.up = x[:11]
        self.version, self.rollbacks, self.used, self.n, self.m = int(version), int(rollbacks), int(used), int(n), int(m)
        k = self.members
        self.weights, self.losses, self.saved = list(x[11 : 11 + k]), list(x[11 + k : 11 + 2 * k]), list(x[11 + 2 * k :])
        return self

    def blend(self, p: list[float]) -> float:
        return sum(w * x for w, x in zip(self.weights, p, strict=True)) / sum(self.weights)

    def learn(self, p: list[float], y: float) -> bool:
        """Takes one settled forecast; whether it made the weights roll back."""
        losses, blended = [loss(x, y) for x in p], loss(self.blend(p), y)
        self.used += 1
        self.blend_loss += blended
        self.losses = [a + b for a, b in zip(self.losses, losses, strict=True)]
        self.weights = floored([w * math.exp(-self.rate * x) for w, x in zip(self.weights, losses, strict=True)], self.floor)
        self.n += 1
        self.mean += (blended - self.mean) / self.n
        self.total += blended - self.mean - self.delta
        self.low = min(self.low, self.total)
        self.m += 1
        self.up = max(0.0, self.up + blended - min(losses) - self.slack)
        if self.n >= self.least and self.total - self.low > self.rise or self.m >= self.least and self.up > self.behind:
            self.weights = list(self.saved) or [1 / self.members] * self.members
            self.calm()
            self.rollbacks, self.version = self.rollbacks + 1, self.version + 1
            return True
        if self.used % self.every == 0 and (not self.saved or self.blend_loss / self.used < self.saved_loss):
            self.saved, self.saved_loss = list(self.weights), self.blend_loss / self.used
        return False


def observations(rows: DataFrame, members: list[str], keys: str = "key", target: str = "target", missing: Column | None = None, voided: Column | None = None, shift: Column | None = None) -> DataFrame:
    """key, ts_us, id, kind, target and members' forecasts: rows as a learner takes them.

    kind says whether a row teaches (event_kind): one without a finite forecast of each member, without target
    or time does not.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    broken = F.coalesce(missing, F.lit(False)) if missing is not None else F.lit(False)
    for c in (target, *members):
        rows = rows.withColumn(c, F.col(c).cast("double"))
        broken = broken | ~finite(c)
    kind = event_kind(broken | F.col("ts_us").isNull(), F.coalesce(voided, F.lit(False)) if voided is not None else F.lit(False), F.coalesce(shift, F.lit(0.0)) if shift is not None else F.lit(0.0), F.lit(False))
    return rows.select(F.col(keys).alias("key"), "ts_us", "id", kind.alias("kind"), F.col(target).alias("target"), *members)


def told(members: list[str]) -> str:
    """The schema of what a replay says about each row: the state once it has been taken."""
    return "key long, id long, kind string, version int, used int, rollbacks int, blend double, blend_loss double, champion_loss double, " + ", ".join(f"{m} double" for m in members)


def one(s: Learner, key: Any, id_: int, kind: str, y: float, p: list[float]) -> tuple:
    """Takes a row if it teaches and says what came of it. blend: the forecast before the row was learnt from."""
    blend = None
    if kind in ("healthy", "market move"):
        blend = s.blend(p)
        if s.learn(p, y):
            kind = "model drift"
    champion = min(s.losses) / s.used if s.used else None
    return (key, id_, kind, s.version, s.used, s.rollbacks, blend, s.blend_loss / s.used if s.used else None, champion, *s.weights)


def replayed(observed: DataFrame, members: list[str], every: int = 25) -> DataFrame:
    """What a learner of each key says about each of observations(), in order of time (rows of one time: by id)."""

    def step(s: Learner, r: Any) -> list[tuple]:
        return [one(s, r.key, r.id, r.kind, r.target, [getattr(r, m) for m in members])]

    return fold(observed, ["key"], ["ts_us", "id"], told(members), lambda: Learner(len(members), every), step)


def latest(told_: DataFrame, observed: DataFrame) -> DataFrame:
    """The state of each key after its last row."""
    both = told_.join(observed.select("key", "id", "ts_us"), ["key", "id"])
    return both.groupBy("key").agg(F.max_by(F.struct(*[c for c in told_.columns if c != "key"]), F.struct("ts_us", "id")).alias("s")).select("key", "s.*")


def anchored(rows: DataFrame, candidates: tuple[float, ...] = ANCHORS, default: float = DEFAULT_ANCHOR, least: int = LEAST_ANCHOR) -> DataFrame:
    """key, id, used, share, loss, market_loss: how much of the model's disagreement with the market has earned its keep so far.

    rows: key, ts_us, id, y (0, 1), model, market (probabilities). Hedge weighs the candidate shares; a rising
    loss makes it forget. Rows whose probabilities are null, not finite or out of range (the market's: 0 or 1)
    teach nothing and are left out. Until `least` rows have taught, the share is the default.
    """
    usable = F.col("model").between(0, 1) & (F.col("market") > 0) & (F.col("market") < 1) & ~F.isnan("model") & ~F.isnan("market") & F.col("y").isNotNull() & F.col("ts_us").isNotNull()

    class Anchor(Learner):
        market_loss = 0.0

    def step(s: Anchor, r: Any) -> list[tuple]:
        p = [min(max(r.market + c * (r.model - r.market), 0.0), 1.0) for c in candidates]
        s.saved = []
        s.learn(p, r.y)
        s.market_loss += loss(r.market, r.y)
        share = default if s.used < least else sum(w * c for w, c in zip(s.weights, candidates, strict=True)) / sum(s.weights)
        return [(r.key, r.id, s.used, share, s.blend_loss / s.used, s.market_loss / s.used)]

    # no checkpoints, and only the loss itself is watched
    begin = lambda: Anchor(len(candidates), every=1 << 60, behind=math.inf)
    columns = rows.where(usable).select("key", "ts_us", "id", F.col("y").cast("double").alias("y"), F.col("model").cast("double").alias("model"), F.col("market").cast("double").alias("market"))
    return fold(columns, ["key"], ["ts_us", "id"], "key long, id long, used int, share double, loss double, market_loss double", begin, step)
