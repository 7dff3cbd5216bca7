"""Whitening of embeddings with moments that are merged pairwise.

Every entry c becomes the whole number floor(1024 c) + 100000. A task reduces its rows to their count,
exact sums and scatter about their own mean; treeReduce merges two such states at a time by Chan's
formula, scatter = scatter_a + scatter_b + d d' n_a n_b / n, where d is the difference of the means, so
nothing is ever computed about zero, far from the data. What is merged, and what the driver factors by
eigh, is as large as the dimension squared, however many rows there are. A second pass whitens all
rows and reduces the result in the same way; the largest entry by which its covariance differs from
the identity comes with every row.

Defined cases: a vector that is null or holds a null or non-finite entry takes no part. Neither does
one of another length than most of the others have (of two lengths equally common, the larger counts).
Rows that repeat an id, or have none, take part one by one. A component whose eigenvalue is zero, or
too small beside the trace to tell from rounding, cannot be whitened and is left out: equal vectors,
or a single one, give no row, and so does an empty table. A deviation that a long cannot hold, or an
entry whose whole number a double cannot, raises OverflowError. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000

#: At most so many components are returned.
COMPONENTS = 8

#: An eigenvalue below this share of the trace, for each dimension, is rounding.
NOTHING = 1e-14

#: A task turns so many entries at a time into numbers.
ENTRIES = 1 << 21

STATE = "n long, total array<double>, exact array<string>, scatter binary"

State = tuple[int, np.ndarray, np.ndarray]


def state(x: np.ndarray) -> State:
    """Count, sums (exact for whole numbers) and scatter about the mean of the rows of x."""
    exact = x.dtype == np.int64
    total = x.sum(axis=0)
    if exact:  # the entries are below 2^53
        total = total.astype(object) if len(x) < 512 or int(np.abs(x).max()) * len(x) < 2**62 else np.array([sum(c) for c in x.T.tolist()], dtype=object)
    if not len(x):
        return 0, total, np.zeros((x.shape[1], x.shape[1]))
    away = x - (total / len(x)).astype(np.float64)
    rest = away.sum(axis=0)
    return len(x), total, away.T @ away - np.outer(rest, rest) / len(x)


def merged(a: State, b: State) -> State:
    """The state of both sets of rows."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    apart = ((b[1] * a[0] - a[1] * b[0]) / (a[0] * b[0])).astype(np.float64)  # of means; sums of whole numbers are Python's, without a limit
    return n, a[1] + b[1], a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])


def matrices(column: pa.ListArray, dimension: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries of the rows that take part, some at a time; of any length if dimension is None, then without entries."""
    lengths = np.diff(column.offsets.to_numpy())
    there = ~np.asarray(column.is_null())
    entries = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    offsets = column.offsets.to_numpy()
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    there &= odd[offsets[1:]] == odd[offsets[:-1]]
    if dimension is None:
        yield np.flatnonzero(there), lengths[there]
        return
    rows = np.flatnonzero(there & (lengths == dimension)) if dimension else there[:0]
    step = max(1, ENTRIES // max(1, dimension))
    for k in range(0, len(rows), step):
        some = rows[k : k + step]
        x = np.floor(SCALE * entries[offsets[some][:, None] + np.arange(dimension)])
        if np.abs(x).max(initial=0) > 2**52:
            raise OverflowError("an entry is too large for a whole number")
        yield some, x.astype(np.int64) + OFFSET


def lists(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    column = batch.column(name)
    return column if isinstance(column, pa.ListArray) else column.cast(pa.list_(pa.float64()))


def dimension(vectors: DataFrame) -> int:
    """The length that most of the vectors have; 0 without any."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lengths in matrices(lists(batch, "v"), None):
                size, times = np.unique(lengths, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(times, pa.int64())], ["size", "times"])

    sizes = vectors.select("v").mapInArrow(counted, "size int, times long").groupBy("size").agg(F.sum("times").alias("times"))
    first = sizes.where("size > 0").orderBy(F.desc("times"), F.desc("size")).first()
    return first["size"] if first else 0


def reduced(vectors: DataFrame, size: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> State:
    """The state of all vectors, or of what change makes of them."""
    width = size if change is None else change(np.zeros((0, size), dtype=np.int64)).shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = (0, np.zeros(width), np.zeros((width, width)))
        for batch in batches:
            for _, x in matrices(lists(batch, "v"), size):
                all_ = merged(all_, state(x if change is None else change(x)))
        n, total, scatter = all_
        values = [[n], [None if change is None else total.tolist()], [list(map(str, total)) if change is None and n else None], [scatter.tobytes()]]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["n", "total", "exact", "scatter"])

    def read(row) -> State:
        total = np.array(row.total) if row.total is not None else np.array(list(map(int, row.exact or [0] * width)), dtype=object)
        return row.n, total, np.frombuffer(row.scatter).reshape(width, width)

    states = vectors.select("v").mapInArrow(local, STATE).rdd.map(read)
    parts = states.getNumPartitions()
    if not parts:
        return 0, np.zeros(width), np.zeros((width, width))
    return states.treeReduce(merged, depth=max(2, math.ceil(math.log(parts, 16))))


@dataclass
class Whitening:
    """The fitted moments and components; a row of `components` is a unit eigenvector."""

    n: int
    total: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        away = x - (self.total / max(1, self.n)).astype(np.float64)
        return away @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact."""
        if not len(x):
            return np.zeros(0, dtype=np.int64)
        most = max(int(self.n) * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(t)) for t in self.total), 1)
        if most < 2**62:
            away = self.n * x - np.array([int(t) for t in self.total], dtype=np.int64)
            if x.shape[1] * int(np.abs(away).max()) ** 2 < 2**63:
                return (away * away).sum(axis=1)
        wide = self.n * x.astype(object) - self.total
        out = (wide * wide).sum(axis=1)
        if max(out) >= 2**63:
            raise OverflowError("a deviation is too large for a long")
        return out.astype(np.int64)


def fitted(moments: State, components: int) -> Whitening:
    n, total, scatter = moments
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * max(1, n)))
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(scatter)) / max(1, n)
    order = order[values[order] > NOTHING * len(values) * trace] if trace > 0 else order[:0]
    rows = vectors.T[order]
    sign = np.sign(np.take_along_axis(rows, np.abs(rows).argmax(axis=1)[:, None], axis=1)) if len(rows) else np.zeros((0, 1))
    return Whitening(n, total, rows * sign, values[order], values[order] / (trace or 1))


def identity_error(vectors: DataFrame, model: Whitening, size: int) -> float:
    """The largest entry by which the covariance of all whitened rows differs from the identity."""
    n, _, scatter = reduced(vectors, size, model.whiten)
    return float(np.abs(scatter / max(1, n) - np.eye(len(scatter))).max(initial=0))


def whiten(table: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """id, deviation and whitened (an array, first component first) of every vector that takes part; the model; its identity error."""
    vectors = table.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    size = dimension(vectors)
    model = fitted(reduced(vectors, size), components)
    error = identity_error(vectors, model, size)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(lists(batch, "v"), size):
                white = model.whiten(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(model.deviation(x), pa.int64()), flat], ["id", "deviation", "whitened"])

    out = vectors.mapInArrow(projected, f"id {dict(vectors.dtypes)['id']}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id), model, error


def whitened_components(table: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    rows, model, error = whiten(table.select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
