"""A quality classifier by positive-unlabelled learning.

A small network maps style features of a whole text to a score. It minimises the non-negative
unbiased risk: pi * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - pi * E_P[l(f, -1)]) with the logistic loss
l, where P are trusted positives (label 1), U are texts whose labels are not looked at, and pi, the
share of good texts, is estimated. The features come from the text alone.

P and U are bounded samples (documented parameters), picked by a hash of the id from the training
fold. The class prior is estimated from P and U alone, never from negative labels: the least
ratio of the upper tails of U and P in the scores of a positive-against-unlabelled classifier.

Defined cases: a null text is an empty one; empty and blank texts have features and get a score; a
row without id is in no fold and is scored like the rest; rows that repeat an id are scored one by
one; labels that are null, that name no document or contradict each other (both values) are not
trusted; without any positive every score is 0.5; an empty table gives an empty result. Columns
other than id and text are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, spool

#: At most so many positives and unlabelled texts are trained on.
POSITIVES, UNLABELLED = 12_000, 24_000

#: Scores from here on are good.
BAR = 0.7

HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 1024, 0.01, 1e-4

UPPER, LOWER, DIGIT, SPACE = (np.array([i for i in range(256) if chr(i) in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r"))
PLAIN = np.array([ord(c) for c in ".,;:'\"-()?!"])
ODD = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?!"])


def features(text: str | None) -> list[float]:
    """Style features of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = hist[hist > 0] / size
    words = text.split()
    n = max(len(words), 1)
    times = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.array(list(times.values()) or [1])
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sentences = int(hist[46] + hist[33] + hist[63])
    letters = max(int(hist[UPPER].sum() + hist[LOWER].sum()), 1)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(raw))),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        float((lengths <= 3).mean()),
        float(hist[UPPER].sum()) / letters,
        float(hist[DIGIT].sum()) / size,
        float(hist[SPACE].sum()) / size,
        float(hist[PLAIN].sum()) / size,
        float(hist[ODD].sum()) / size,
        float(hist[33] + hist[63]) / size,
        float(hist[128:].sum()) / size,
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        len(times) / n,
        float(counts.max()) / n,
        float((counts[counts > 1]).sum()) / n,
        len(pairs) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        repeats / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1) / 20,
        sentences / n,
        len(zlib.compress(raw, 1)) / size if len(raw) else 1.0,
    ]


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(np.c_[z, np.ones(len(z))] @ self.first)
        return 1 / (1 + np.exp(-np.clip(np.c_[h, np.ones(len(h))] @ self.second, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 11, steps: int = STEPS) -> Network:
    """Minimises the non-negative risk with prior; the positive-against-unlabelled log loss where prior is None."""
    every = np.concatenate([positive, unlabelled])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-6, np.zeros(0), np.zeros(0))
    p, u = (np.c_[np.clip((x - net.mean) / net.scale, -6, 6), np.ones(len(x))] for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), rng.normal(0, 0.1, HIDDEN + 1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), min(BATCH, len(p)))], u[rng.integers(0, len(u), min(BATCH, len(u)))]
        x = np.concatenate([a, b])
        h = np.tanh(x @ w[0])
        hb = np.c_[h, np.ones(len(h))]
        f = np.clip(hb @ w[1], -30, 30)
        s = 1 / (1 + np.exp(-f))
        fa, sa, sb = f[: len(a)], s[: len(a)], s[len(a) :]
        if prior is None:
            d = np.concatenate([(sa - 1) / len(a), sb / len(b)])
        else:
            negative = np.logaddexp(0, f[len(a) :]).mean() - prior * np.logaddexp(0, fa).mean()
            if negative >= 0:
                d = np.concatenate([(prior * (sa - 1) - prior * sa) / len(a), sb / len(b)])
            else:  # the part that should not be negative is pushed back up
                d = np.concatenate([prior * sa / len(a), -sb / len(b)])
        grads = [x.T @ (np.outer(d, w[1][:-1]) * (1 - h * h)), hb.T @ d]
        rate = RATE * (1 - t / (steps + 1))
        for i in range(2):
            grad = grads[i] + DECAY * w[i]
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.first, net.second = w
    return net


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled data, where labels are missing at random.

    A classifier of positives against unlabelled texts, each half scored by what the other half has taught.
    From a score on, unlabelled data hold at least the share of positives times what positives have there,
    so the least ratio of the two tails bounds the share; one standard error is taken off, as a prior that
    is too high keeps bad texts.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for half in (0, 1):
        net = fit(positive[half::2], unlabelled[half::2], None, steps=400)
        p[1 - half :: 2], u[1 - half :: 2] = net.score(positive[1 - half :: 2]), net.score(unlabelled[1 - half :: 2])
    cuts = np.unique(np.quantile(np.concatenate([p, u]), np.linspace(0, 0.98, 99)))
    above = np.array([[(x >= c).mean() for c in cuts] for x in (p, u)])
    error = np.sqrt(above[0] * (1 - above[0]) / len(p) + above[1] * (1 - above[1]) / len(u))
    return float(np.clip(((above[1] - error) / above[0])[above[0] > 0.5].min(), 0.05, 0.98))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(x, pa.list_(pa.float64()))], ["positive", "x"])


def drawn_by_hash(ids: DataFrame, most: int, salt: int) -> DataFrame:
    """At most so many distinct ids, those of the smallest hashes; a task passes on few more than its share."""
    turn = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40))
    share = min(1.0, 1.2 * (most + 1000) / max(1, ids.count()))
    return ids.select("doc_id", turn.alias("turn")).where(F.col("turn") < int(share * (1 << 40))).distinct().orderBy("turn", "doc_id").limit(most)


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """Fits the network; documents and labels of the training fold alone."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    marked = spool(marked.where("low = high").select("doc_id", F.col("low").alias("quality")), "trusted")
    good, all_ = marked.where("quality = 1"), documents.where("doc_id is not null").select("doc_id")
    trusted = drawn_by_hash(good, positives, 5).select("doc_id", F.lit(True).alias("positive"))
    drawn = drawn_by_hash(all_, unlabelled, 6).select("doc_id", F.lit(False).alias("positive"))
    picked = spool(trusted.unionByName(drawn), "picked")  # at most positives + unlabelled rows
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("positive", "text")
    rows = texts.mapInArrow(_features, "positive boolean, x array<double>")
    # an id that many rows repeat could bring in more than were picked; the same ones stay every time
    rows = rows.orderBy(F.xxhash64("x"), "x", "positive").limit(2 * (positives + unlabelled)).toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, 1))
    p, u = (x[rows["positive"].to_numpy(dtype=bool) == k] for k in (True, False))
    if not len(p) or not len(u):
        return None
    return fit(p, u, estimated_prior(p, u))


def score(documents: DataFrame, net: Network | None, name: str = "score") -> DataFrame:
    """documents with a further column for the score, of a name that they do not have."""
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), -1)
            s = net.score(x) if net is not None and len(texts) else np.full(len(texts), 0.5)
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64())], [*batch.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def in_fold(modulus: int = 4, fold: int = 2) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), modulus) == fold, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    net = train(documents.where(~in_fold()), labels.where(~in_fold()))
    scored = score(documents.select("doc_id", in_fold().alias("held_out"), "text"), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= BAR).cast("int").alias("predicted"))


def good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    net = train(documents.where(~in_fold()), labels.where(~in_fold()))
    name = "quality_score"
    while name in documents.columns:
        name += "_"
    return score(documents, net, name).where(F.col(name) >= BAR).drop(name)
