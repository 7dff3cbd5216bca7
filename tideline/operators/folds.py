"""Ordered folds: what depends on every earlier row of a key in turn.

Spark deals the keys out and sorts each key's rows (spilling where it must); a task streams them through
and holds one key's small state, never its history. A key's rows are folded by one task, one after
another, as that is what a fold is. Folds over all rows together (no key) are not offered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[Any, Any], list[tuple]]


def fold(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Step) -> DataFrame:
    """The rows that step(state, row) returns for each row of a key, in order; start() makes a key's state, which step changes."""
    names, width = [c.split()[0] for c in schema.split(", ")], len(keys)
    columns = [*keys, *[c for c in rows.columns if c not in keys]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(None if x != x else x for x in row[:width])
                if state is None or key != now:
                    now, state = key, start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def rating(rows: DataFrame, k: float = 20.0, home: float = 60.0, start: float = 1500.0) -> DataFrame:
    """id, before_home, before_away: ratings as they stood before the day. rows: league, day, id, home, away, score (1, 0.5, 0).

    All of a day's rows see the ratings of the day before; then all of them count.
    """

    def begin() -> dict:
        return {"day": None, "now": {}, "moved": {}}

    def step(s: dict, r: Any) -> list[tuple]:
        if r.day != s["day"]:
            for team, gain in s["moved"].items():
                s["now"][team] = s["now"].get(team, start) + gain
            s.update(day=r.day, moved={})
        x, y = s["now"].get(r.home, start), s["now"].get(r.away, start)
        gain = k * (r.score - 1 / (1 + 10 ** ((y - x - home) / 400)))
        s["moved"][r.home] = s["moved"].get(r.home, 0) + gain
        s["moved"][r.away] = s["moved"].get(r.away, 0) - gain
        return [(r.id, x, y)]

    return fold(rows, ["league"], ["day", "id"], "id long, before_home double, before_away double", begin, step)


def alarms(rows: DataFrame, delta: float = 0.005, threshold: float = 0.35, slack: float = 0.004, bar: float = 0.25, least: int = 20) -> DataFrame:
    """key, id, drifted, degraded, improved of rows key, ts_us, id, loss, difference.

    drifted: the loss rose over its running mean. degraded, improved: the difference of two losses ran off
    upwards or downwards, each beyond a slack. Each test needs `least` rows and starts again after its alarm.
    """

    def begin() -> dict:
        return {"n": 0, "mean": 0.0, "cum": 0.0, "low": 0.0, "m": 0, "up": 0.0, "down": 0.0}

    def step(s: dict, r: Any) -> list[tuple]:
        s["n"] += 1
        s["mean"] += (r.loss - s["mean"]) / s["n"]
        s["cum"] += r.loss - s["mean"] - delta
        s["low"] = min(s["low"], s["cum"])
        drifted = s["n"] >= least and s["cum"] - s["low"] > threshold
        s["m"] += 1
        s["up"], s["down"] = max(0.0, s["up"] + r.difference - slack), min(0.0, s["down"] + r.difference + slack)
        worse, better = s["m"] >= least and s["up"] > bar, s["m"] >= least and s["down"] < -bar
        if drifted:
            s.update(n=0, mean=0.0, cum=0.0, low=0.0)
        if worse or better:
            s.update(m=0, up=0.0, down=0.0)
        return [(r.key, r.id, drifted, worse, better)]

    return fold(rows, ["key"], ["ts_us", "id"], "key long, id long, drifted boolean, degraded boolean, improved boolean", begin, step)


def hedged(rows: DataFrame, models: list[str], rate: float = 0.6, floor: float = 0.03) -> DataFrame:
    """key, id and the weights of models before each row; what falls under the floor is held there. rows: key, ts_us, id, y, models' probabilities."""

    def step(w: list[float], r: Any) -> list[tuple]:
        out = [(r.key, r.id, *w)]
        w[:] = floored([a * 2.718281828459045 ** (-rate * (getattr(r, m) - r.y) ** 2) for a, m in zip(w, models, strict=True)], floor)
        return out

    schema = "key long, id long, " + ", ".join(f"{m} double" for m in models)
    return fold(rows, ["key"], ["ts_us", "id"], schema, lambda: [1 / len(models)] * len(models), step)


def floored(w: list[float], floor: float) -> list[float]:
    """w scaled to sum 1, with what would fall under the floor held there; what is not held shares the rest, once."""
    whole = sum(w)
    scaled = [x / whole for x in w] if 0 < whole < float("inf") else [1 / len(w)] * len(w)
    held = [x <= floor for x in scaled]
    rest, free = 1 - floor * sum(held), sum(x for x, h in zip(scaled, held, strict=True) if not h)
    if not any(held):
        return scaled
    return [floor if h else x / free * rest for x, h in zip(scaled, held, strict=True)] if rest > 0 else [1 / len(w)] * len(w)


def changed(last: tuple | None, at: int, value: float, heartbeat: int, tolerance: float) -> bool:
    """Whether a quote is written: the first, a changed one, or one so long after the last written."""
    return last is None or abs(value - last[1]) > tolerance or at - last[0] >= heartbeat


def change_log(rows: DataFrame, heartbeat: int = 600_000_000, tolerance: float = 0.0) -> DataFrame:
    """key, id, ts_us, value of the quotes that an append-only log keeps. rows: the same."""

    def step(s: dict, r: Any) -> list[tuple]:
        if not changed(s.get("last"), r.ts_us, r.value, heartbeat, tolerance):
            return []
        s["last"] = (r.ts_us, r.value)
        return [(r.key, r.id, r.ts_us, r.value)]

    return fold(rows.select("key", "id", "ts_us", "value"), ["key"], ["ts_us", "id"], "key long, id long, ts_us long, value double", dict, step)


def chained(rows: DataFrame) -> DataFrame:
    """key, id, link: the hash of each row's content and of the link before it, so that no earlier row can change unseen. rows: key, ts_us, id, content."""

    def step(s: dict, r: Any) -> list[tuple]:
        s["link"] = hashlib.sha256(f"{r.key}:{r.id}:{r.content}:{s.get('link', '')}".encode()).hexdigest()
        return [(r.key, r.id, s["link"])]

    return fold(rows.select("key", "ts_us", "id", "content"), ["key"], ["ts_us", "id"], "key long, id long, link string", dict, step)
