"""What each feature is worth out of sample, for the price of two passes over the rows.

The folds' training parts begin together and end one after another, so the days fall into stretches between
their ends. One aggregation adds up, by stretch, the products of every two features and the target; a
fold's sums are those of its stretches, and every model of a subset of features is solved from rows and
columns of the same matrix. A second pass scores all models of all folds on their test rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import folds

#: Folds, days between training and test, features kept at most, rows that a fold must learn from.
FOLDS, KEPT, LEAST = 3, 5, 80


class Sweep:
    """Folds of some rows, with the moments that any subset of the features is fitted from. Rows with a null feature, target or day are left out."""

    def __init__(self, rows: DataFrame, features: list[str], y: str, day: str, n: int = FOLDS, ridge: float = 1e-3, line: float = 9.5) -> None:
        self.features, self.y, self.ridge, self.line = features, y, ridge, line
        columns = [*features, y]
        rows = rows.select(F.col(day).cast("long").alias("__day"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
        self.rows = rows.where(F.lit(True) if not columns else ~F.greatest(*[F.isnan(c).cast("int") for c in columns], F.lit(0)).cast("boolean"))
        parts = folds(self.rows, "__day", n).groupBy("fold").agg(*[f(F.when(F.col("part") == p, F.col("__day"))).alias(a) for f, p, a in ((F.max, "train", "ends"), (F.min, "test", "begins"), (F.max, "test", "last"))])
        self.folds = [r for r in parts.orderBy("fold").collect() if None not in (r.ends, r.begins, r.last)]  # n rows
        self.sums = self._sums(columns)
        self.sums = {k: v for k, v in self.sums.items() if v[0, 0] >= LEAST}

    def _sums(self, columns: list[str]) -> dict[int, np.ndarray]:
        """By fold the sums of products of (1, features, y) over its training rows."""
        if not self.folds:
            return {}
        stretch = sum(((F.col("__day") > f.ends).cast("int") for f in self.folds), F.lit(0))
        whole = [F.lit(1.0), *map(F.col, columns)]
        pairs = [(i, j) for i in range(len(whole)) for j in range(i, len(whole))]
        found = self.rows.groupBy(stretch.alias("s")).agg(*[F.sum(whole[i] * whole[j]).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]).collect()
        by = {}
        for k, f in enumerate(self.folds):
            m = np.zeros((len(whole), len(whole)))
            for r in found:
                if r.s <= k:
                    for n, (i, j) in enumerate(pairs):
                        m[i, j] += r[f"m{n}"]
            by[f.fold] = np.triu(m) + np.triu(m, 1).T
        return by

    def weights(self, fold: int, kept: list[int]) -> np.ndarray:
        """Intercept and weights (0 for what is not kept) of a fold's ridge regression on the kept features, each as wide as the others."""
        m = self.sums[fold]
        n, width = m[0, 0], len(self.features)
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        out = np.zeros(width + 1)
        scale = np.sqrt(np.maximum(np.diag(cov)[:width], 0))
        kept = [i for i in kept if scale[i] > 1e-12]
        if kept:
            a = cov[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])
            out[1 + np.array(kept)] = np.linalg.solve(a + self.ridge * np.eye(len(kept)), cov[kept, width] / scale[kept]) / scale[kept]
        out[0] = mean[width] - out[1:] @ mean[:width]
        return out

    def scores(self, subsets: list[list[int]]) -> pd.DataFrame:
        """subset, fold, n, mae, brier, baseline_mae: of every subset in every fold, in one pass. brier: of the target being above the line, as a Poisson count."""
        models = {f: np.stack([self.weights(f, s) for s in subsets]) for f in self.sums}
        edges = [(f.fold, f.begins, f.last, self.sums[f.fold][0, -1] / self.sums[f.fold][0, 0]) for f in self.folds if f.fold in models]
        features, y, line = self.features, self.y, self.line
        k = np.arange(int(np.floor(line)) + 1)
        log_k = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))])
        names = ["fold", "subset", "n", "mae", "brier", "baseline"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                day, target = batch.column("__day").to_numpy(), batch.column(y).to_numpy()
                x = np.stack([np.ones(len(day)), *[batch.column(c).to_numpy() for c in features]], axis=1)
                for fold, begins, last, mean in edges:
                    at = (day >= begins) & (day <= last)
                    guess = np.maximum(x[at] @ models[fold].T, 0.05)
                    below = np.exp(k * np.log(guess)[..., None] - guess[..., None] - log_k).sum(axis=-1)
                    off = np.abs(guess - target[at, None]).sum(axis=0)
                    brier = ((1 - below - (target[at, None] > line)) ** 2).sum(axis=0)
                    now = np.stack([np.full(len(off), at.sum()), off, brier, np.full(len(off), np.abs(target[at] - mean).sum())])
                    total[fold] = total.get(fold, 0) + now
            rows = [(f, i, *v[:, i]) for f, v in total.items() for i in range(v.shape[1])]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"fold": "int32", "subset": "int32"}), preserve_index=False)

        if not edges:
            return pd.DataFrame(columns=["subset", "fold", "n", "mae", "brier", "baseline_mae"])
        parts = self.rows.mapInArrow(run, "fold int, subset int, n double, mae double, brier double, baseline double").groupBy("subset", "fold").agg(*[F.sum(c).alias(c) for c in names[2:]])
        out = parts.where("n > 0").orderBy("subset", "fold").toPandas()  # a row a subset and fold
        return out.assign(mae=out["mae"] / out["n"], brier=out["brier"] / out["n"], baseline_mae=out["baseline"] / out["n"]).drop(columns="baseline")

    def summary(self, subsets: list[list[int]]) -> pd.DataFrame:
        """mae, brier, folds of each subset: means over the folds, each by its rows."""
        s = self.scores(subsets)
        g = s.assign(a=s["mae"] * s["n"], b=s["brier"] * s["n"]).groupby("subset").agg(a=("a", "sum"), b=("b", "sum"), n=("n", "sum"), folds=("fold", "nunique"))
        return pd.DataFrame({"mae": g["a"] / g["n"], "brier": g["b"] / g["n"], "folds": g["folds"], "n": g["n"]}).reindex(range(len(subsets)))


def ablation(rows: DataFrame, features: list[str], y: str, day: str, **how) -> pd.DataFrame:
    """feature, mae_delta, brier_delta, folds: what dropping each feature costs out of sample. Empty with fewer than two folds."""
    sweep = Sweep(rows, features, y, day, **how)
    everything = list(range(len(features)))
    s = sweep.summary([everything, *[[j for j in everything if j != i] for i in everything]])
    if not len(s) or not s["folds"].iloc[0] >= 2:
        return pd.DataFrame(columns=["feature", "mae_delta", "brier_delta", "folds"])
    return pd.DataFrame({"feature": features, "mae_delta": (s["mae"].iloc[1:] - s["mae"].iloc[0]).to_numpy(), "brier_delta": (s["brier"].iloc[1:] - s["brier"].iloc[0]).to_numpy(), "folds": s["folds"].iloc[1:].astype(int).to_numpy()})


def selected(rows: DataFrame, features: list[str], y: str, day: str, most: int = KEPT, **how) -> dict:
    """features, adopted, base_mae, kept_mae, folds, note: the features whose loss costs most, if together they are no worse than all."""
    sweep = Sweep(rows, features, y, day, **how)
    everything = list(range(len(features)))
    s = sweep.summary([everything, *[[j for j in everything if j != i] for i in everything]])
    if not len(s) or not s["folds"].iloc[0] >= 2:
        return {"features": features, "adopted": False, "base_mae": None, "kept_mae": None, "folds": 0, "note": "too few folds"}
    base, folds_ = float(s["mae"].iloc[0]), int(s["folds"].iloc[0])
    cost = [(float(s["mae"].iloc[i + 1]) - base, i) for i in everything]
    ranked = [i for c, i in sorted(cost, key=lambda x: (-x[0], x[1])) if c > 0]
    if not ranked:
        return {"features": features, "adopted": False, "base_mae": base, "kept_mae": None, "folds": folds_, "note": "no feature shows a signal"}
    kept = sorted(ranked[:most])
    mae = float(sweep.summary([kept])["mae"].iloc[0])
    adopted = mae <= base
    return {"features": [features[i] for i in kept] if adopted else features, "adopted": adopted, "base_mae": base, "kept_mae": mae, "folds": folds_, "note": "" if adopted else "fewer features did worse"}
