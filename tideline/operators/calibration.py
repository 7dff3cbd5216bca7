"""Calibration by key: the method that a key's sample size allows, and corrections to a market price that must prove themselves.

Models are rows: a table of methods, temperatures and knots that is joined back to what it corrects. Samples
that share a score are one cell before anything is fitted. The isotonic steps of a key come from neighbours
pooled where the sorted cells lie, whatever key they are of, and then once more over the pooled blocks of
each key, which for shares of yes and no are far fewer than the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY, logit, sigmoid
from .joins import beside

#: So many samples a key needs for a temperature, and for isotonic steps.
TEMPERATURE, ISOTONIC = 50, 200

#: Scores are looked up in so many ranges.
RANGES = 256

#: So many samples a residual needs, the latest share of which judges it, and the widest disagreement that counts.
RESIDUAL, HELD, CAP = 60, 0.3, 2.0

#: A key of more different samples than this is fitted by passes over the table instead of in one group.
CELLS = 1_000_000


def valid(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Rows whose score is a probability and whose outcome is known."""
    return rows.where(F.col(p).between(0, 1) & ~F.isnan(p) & F.col(y).isNotNull())


def pooled(bound: np.ndarray, value: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """(bound, value, weight) of blocks in rising order, neighbours that fall pooled."""
    out: list[list[float]] = []
    for b, v, w in zip(bound.tolist(), value.tolist(), weight.tolist(), strict=True):
        out.append([b, v, w])
        while len(out) > 1 and out[-2][1] > out[-1][1]:
            b, v, w = out.pop()
            low = out[-1]
            low[:] = [b, (low[1] * low[2] + v * w) / (low[2] + w), low[2] + w]
    return out


def _blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells pooled within each task of a sort by key and score."""
    width = len(keys)
    schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys) + ", bound double, value double, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = tuple(None if x != x else x for x in row[:width])
                if key != now:
                    if rows:
                        yield pd.DataFrame([(*now, *r) for r in rows], columns=[*keys, "bound", "value", "weight"])
                    now, rows = key, []
                rows.append([row.p, row.hits / row.n, row.n])
                while len(rows) > 1 and rows[-2][1] > rows[-1][1]:
                    b, v, w = rows.pop()
                    rows[-1][:] = [b, (rows[-1][1] * rows[-1][2] + v * w) / (rows[-1][2] + w), rows[-1][2] + w]
        if rows:
            yield pd.DataFrame([(*now, *r) for r in rows], columns=[*keys, "bound", "value", "weight"])

    return cells.select(*keys, "p", "n", "hits").repartitionByRange(*keys, "p").sortWithinPartitions(*keys, "p").mapInPandas(run, schema)


def scaled(z: np.ndarray, n: np.ndarray, hits: np.ndarray, steps: int = 400, rate: float = 0.05) -> tuple[float, float]:
    """Temperature and bias by gradient steps on the log loss; z: logits."""
    t, b, size = 1.0, 0.0, n.sum()
    for _ in range(steps):
        error = n / (1 + np.exp(-(z / t + b))) - hits
        t, b = min(max(t - rate * (error * -z).sum() / (t * t) / size, 0.25), 6.0), b - rate * error.sum() / size
    return t, b


def ladder(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """keys, n, method, temperature, bias, knots: what fits each key's samples.

    Fewer than TEMPERATURE samples: identity. Fewer than ISOTONIC: a temperature and a bias. Else isotonic, by
    knots of (upper bound, share), rising.
    """
    cells = valid(rows, p, y).groupBy(*keys, F.col(p).cast("double").alias("p")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("hits"))
    totals = cells.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"))
    sized = beside(cells, totals.withColumnRenamed("n", "size"), keys)
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def one_temperature(g: pd.DataFrame) -> pd.DataFrame:  # of fewer than ISOTONIC samples
        q = np.clip(g["p"].to_numpy(), 1e-6, 1 - 1e-6)
        t, b = scaled(np.log(q / (1 - q)), g["n"].to_numpy(), g["hits"].to_numpy())
        return g[keys].iloc[:1].assign(temperature=t, bias=b)

    def one_ladder(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bound")
        steps = pooled(g["bound"].to_numpy(), g["value"].to_numpy(), g["weight"].to_numpy())
        return g[keys].iloc[:1].assign(knots=[[{"bound": b, "value": v} for b, v, _ in steps]])

    warm = sized.where(F.col("size").between(TEMPERATURE, ISOTONIC - 1)).groupBy(*keys).applyInPandas(one_temperature, f"{kinds}, temperature double, bias double")
    steps = _blocks(sized.where(F.col("size") >= ISOTONIC), keys).groupBy(*keys).applyInPandas(one_ladder, f"{kinds}, knots array<struct<bound:double,value:double>>")
    method = F.when(F.col("n") < TEMPERATURE, "identity").when(F.col("n") < ISOTONIC, "temperature").otherwise("isotonic")
    return beside(beside(totals, warm, keys), steps, keys).select(*keys, "n", method.alias("method"), "temperature", "bias", "knots")


def calibrated(rows: DataFrame, models: DataFrame, keys: list[str], p: str, name: str = "calibrated") -> DataFrame:
    """rows with a further column: the score as its key's model has it; as it is, within 0 and 1, for a key without one.

    A knot covers the scores above the one before it up to its own; it is laid beside every range of scores that it
    touches, and a score meets the few knots of its range.
    """
    span = F.transform("knots", lambda k, i: F.struct(F.when(i == 0, 0.0).otherwise(F.get("knots", i - 1)["bound"]).alias("low"), F.when(i == F.size("knots") - 1, 1.0).otherwise(k["bound"]).alias("high"), k["value"].alias("value")))
    at = lambda c: F.least(F.floor(c * RANGES), F.lit(RANGES - 1)).cast("int")
    knots = models.where("method = 'isotonic'").select(*keys, F.explode(span).alias("k")).select(*keys, "k.high", "k.value", F.explode(F.sequence(at(F.col("k.low")), at(F.col("k.high")))).alias("__range"))
    knots = knots.groupBy(*keys, "__range").agg(F.sort_array(F.collect_list(F.struct("high", "value"))).alias("__knots"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p).cast("double")))
    rows = rows.withColumn("__range", at(score))
    rows = beside(rows, models.select(*keys, F.col("method").alias("__method"), F.col("temperature").alias("__t"), F.col("bias").alias("__b")), keys)
    rows = beside(rows, knots, [*keys, "__range"])
    step = F.element_at(F.filter("__knots", lambda k: score <= k["high"]), 1)["value"]
    out = F.when(F.col("__method") == "temperature", sigmoid(logit(score) / F.col("__t") + F.col("__b"))).when(F.col("__method") == "isotonic", step).otherwise(score)
    return rows.withColumn(name, F.when(F.col(p).isNotNull() & ~F.isnan(p), out)).drop("__range", "__method", "__t", "__b", "__knots")


def report(rows: DataFrame, keys: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """keys, n, base_rate, brier, baseline, skill, expected_error, maximum_error, reliable, beats: how good a key's scores are.

    A key beats its base rate where its skill is above one over the root of its samples, of which it needs TEMPERATURE.
    """
    y_, p_ = F.col(y).cast("double"), F.col(p).cast("double")
    b = F.least(F.floor(p_ * bins), F.lit(bins - 1)).alias("__bin")
    cells = valid(rows, p, y).groupBy(*keys, b).agg(F.count("*").alias("n"), F.sum(p_).alias("p"), F.sum(y_).alias("y"), F.sum((p_ - y_) * (p_ - y_)).alias("e"))
    gap = F.abs(F.col("y") - F.col("p"))
    g = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("e").alias("e"), F.sum(gap).alias("gap"), F.max(gap / F.col("n")).alias("maximum_error"))
    base, n = F.col("y") / F.col("n"), F.col("n")
    g = g.select(*keys, "n", base.alias("base_rate"), (F.col("e") / n).alias("brier"), (base * (1 - base)).alias("baseline"), (F.col("gap") / n).alias("expected_error"), "maximum_error")
    skill = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("brier")) / F.col("baseline")).otherwise(0.0)
    return g.withColumns({"skill": skill, "reliable": n >= TEMPERATURE}).withColumn("beats", F.col("reliable") & (F.col("skill") > 1 / F.sqrt(n)))


def earliest(rows: DataFrame, keys: list[str], ts_us: str, id_: str, share: float, name: str) -> DataFrame:
    """rows with whether each is among its key's earliest share (at least one), and `__n`, its key's rows.

    Days are counted first, and only what lies within a day is put in order: a large key is spread over its days.
    """
    rows = rows.withColumn("__day", F.floor(F.col(ts_us) / DAY).cast("long"))
    days = rows.groupBy(*keys, "__day").agg(F.count("*").alias("__rows"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__rows").over(w.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*keys, "__day", before.alias("__before"), F.sum("__rows").over(w).alias("__n"))
    place = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(ts_us, id_)) + F.col("__before")
    split = F.greatest(F.lit(1), F.floor(F.col("__n") * share + 1e-9))
    return beside(rows, days, [*keys, "__day"]).withColumn(name, place <= split).drop("__day", "__before")


def _fit(z: np.ndarray, gap: np.ndarray, n: np.ndarray, hits: np.ndarray, steps: int, rate: float, ridge: float) -> tuple[float, float]:
    bias, weight, size = 0.0, 0.0, n.sum()
    for _ in range(steps):
        error = n / (1 + np.exp(-(z + bias + weight * gap))) - hits
        bias, weight = bias - rate * (error.sum() / size + ridge * bias), weight - rate * ((error * gap).sum() / size + ridge * weight)
    return float(bias), float(weight)


def residuals(rows: DataFrame, keys: list[str], model: str, market: str, y: str, ts_us: str = "ts_us", id_: str = "id", steps: int = 400, rate: float = 0.08, ridge: float = 0.05, cells: int = CELLS) -> DataFrame:
    """keys, n, holdout, bias, weight, brier, market_brier, log_loss, market_log_loss, adopted: corrections to market prices.

    The log odds of the market plus bias plus weight times the model's disagreement, in log odds within +-CAP.
    Fitted on a key's earlier samples, adopted only if on its latest both scores are better than the market's.
    Probabilities of 0, 1 or none take no part; keys of fewer than RESIDUAL samples are not fitted.
    """
    good = lambda c: (F.col(c) > 0) & (F.col(c) < 1) & ~F.isnan(c)
    gap = F.least(F.greatest(logit(F.col(model)) - logit(F.col(market)), F.lit(-CAP)), F.lit(CAP))
    used = rows.where(good(model) & good(market) & F.col(y).isNotNull() & F.col(ts_us).isNotNull()).select(*keys, ts_us, id_, F.col(market).cast("double").alias("q"), logit(F.col(market)).alias("z"), gap.alias("gap"), F.col(y).cast("double").alias("y"))
    split = earliest(used, keys, ts_us, id_, 1 - HELD, "learns")
    grouped = split.where((F.col("__n") >= RESIDUAL) & F.col("learns")).groupBy(*keys, "z", "gap").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("hits"))
    sizes = grouped.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum("n").alias("size"))
    kinds = ", ".join(f"{k} {used.schema[k].dataType.simpleString()}" for k in keys)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        bias, weight = _fit(*(g[c].to_numpy() for c in ("z", "gap", "n", "hits")), steps, rate, ridge)
        return g[keys].iloc[:1].assign(bias=bias, weight=weight)

    few = beside(grouped, sizes, keys).where(F.col("cells") <= cells).groupBy(*keys).applyInPandas(one, f"{kinds}, bias double, weight double")
    large = [tuple(r) for r in sizes.where(F.col("cells") > cells).select(*keys, "size").collect()]  # each stands for more than `cells` rows
    if large:
        few = few.unionByName(_by_passes(grouped, keys, large, steps, rate, ridge))
    held = beside(split.where(~F.col("learns")), few, keys).where("bias is not null")
    fixed = sigmoid(F.col("z") + F.col("bias") + F.col("weight") * F.col("gap"))
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    entropy = lambda p: -(F.col("y") * F.log(bounded(p)) + (1 - F.col("y")) * F.log(1 - bounded(p)))
    error = lambda p: (p - F.col("y")) * (p - F.col("y"))
    q = F.col("q")
    scores = held.groupBy(*keys).agg(F.count("*").alias("holdout"), F.avg(error(fixed)).alias("brier"), F.avg(error(q)).alias("market_brier"), F.avg(entropy(fixed)).alias("log_loss"), F.avg(entropy(q)).alias("market_log_loss"))
    out = beside(beside(used.groupBy(*keys).agg(F.count("*").alias("n")), few, keys), scores, keys)
    adopted = (F.col("brier") < F.col("market_brier")) & (F.col("log_loss") < F.col("market_log_loss"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*keys, "n", F.coalesce("holdout", F.lit(0)).alias("holdout"), *[zero(c) for c in ("bias", "weight", "brier", "market_brier", "log_loss", "market_log_loss")], F.coalesce(adopted, F.lit(False)).alias("adopted"))


def _by_passes(grouped: DataFrame, keys: list[str], large: list[tuple], steps: int, rate: float, ridge: float) -> DataFrame:
    """The same steps for keys too large for one group: one aggregation a step over all of them."""
    spark = grouped.sparkSession
    schema = ", ".join(f"{k} {grouped.schema[k].dataType.simpleString()}" for k in keys) + ", size double, bias double, weight double"
    now = [(*r, 0.0, 0.0) for r in large]
    for _ in range(steps):
        state = spark.createDataFrame(now, schema)
        named = state.select(*[F.col(k).alias(f"__{k}") for k in keys], "size", "bias", "weight")
        both = grouped.join(F.broadcast(named), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])  # a row a large key
        error = F.col("n") * sigmoid(F.col("z") + F.col("bias") + F.col("weight") * F.col("gap")) - F.col("hits")
        bias, weight, size = F.col("bias"), F.col("weight"), F.col("size")
        moved = (bias - rate * (F.sum(error) / size + ridge * bias)), (weight - rate * (F.sum(error * F.col("gap")) / size + ridge * weight))
        now = [tuple(r) for r in both.groupBy(*[F.col(f"__{k}").alias(k) for k in keys], "size", "bias", "weight").agg(moved[0].alias("b"), moved[1].alias("w")).select(*keys, "size", "b", "w").collect()]
    return spark.createDataFrame(now, schema).drop("size")


def corrected(rows: DataFrame, models: DataFrame, keys: list[str], model: str, market: str, name: str = "corrected") -> DataFrame:
    """rows with a further column: the market's probability, corrected where the key's correction has been adopted."""
    rows = beside(rows, models.select(*keys, F.col("bias").alias("__b"), F.col("weight").alias("__w"), F.col("adopted").alias("__a")), keys)
    gap = F.least(F.greatest(logit(F.col(model)) - logit(F.col(market)), F.lit(-CAP)), F.lit(CAP))
    fixed: Column = sigmoid(logit(F.col(market)) + F.col("__b") + F.col("__w") * gap)
    plain = F.least(F.greatest(F.col(market), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn(name, F.when(F.col("__a"), F.coalesce(fixed, plain)).otherwise(plain)).drop("__b", "__w", "__a")
