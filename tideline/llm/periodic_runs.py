"""Periodic runs of words, found by probing a harmonic grid.

A run is a maximal stretch of words with smallest period q, at least max(24, 3 q) words long. Where a
run has period p, the words at i and i + p agree over 2 p consecutive i or more, so two neighbours on
the grid of multiples of p lie there: w[jp] = w[(j+1)p] = w[(j+2)p]. The probes for all p up to n / 3
touch n/1 + n/2 + ... words, n log n in all. Survivors are probed at further offsets between the two
grid points, where a run must agree as well, and what is left is extended either way by comparing
arrays in growing chunks. Periods are tried in rising order; a window of two periods that lies in a
run found before would have that run's smaller period (Fine and Wilf), so its grid points are skipped,
and whatever is extended has p as its smallest period.

Texts of a batch are laid end to end, longest first, with a number of its own between any two, so that
one comparison probes all texts that are long enough for p.

Defined cases: a null or blank text has no words and no run; a null id is scored like the rest; rows
that repeat an id or a text are scored one by one; an empty table gives an empty result. Words are
the maximal stretches of [^\\x20\\x09-\\x0D], compared byte by byte and numbered exactly, not by a hash.
A text is never cut: a task holds some WORDS words at a time, or one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3

#: A task compares so many words at a time, or one longer text.
WORDS = 1_000_000

RUN = "array<struct<start:long,length:long,period:long>>"


def ahead(a: np.ndarray, at: int, p: int) -> int:
    """The first position after `at` where a[i] != a[i + p]."""
    i, size, high = at + 1, 32, len(a) - p
    while i < high:
        off = a[i : min(i + size, high)] != a[i + p : min(i + size, high) + p]
        first = int(off.argmax())
        if off[first]:
            return i + first
        i += len(off)
        size *= 2
    return high


def back(a: np.ndarray, at: int, p: int) -> int:
    """The first position from which a[i] = a[i + p] all the way to `at`."""
    i, size = at, 32
    while i > 0:
        low = max(i - size, 0)
        off = (a[low:i] != a[low + p : i + p])[::-1]
        first = int(off.argmax())
        if off[first]:
            return i - first
        i = low
        size *= 2
    return 0


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start, then period; a text is an array of word numbers from 0."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = [k for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])) if len(texts[k]) >= LEAST]
    if not order:
        return found
    sizes = np.array([len(texts[k]) for k in order])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    a = np.full(starts[-1], -1, dtype=np.int64)
    for k, s in zip(order, starts, strict=False):
        a[s : s + len(texts[k])] = texts[k]
    a[starts[1:] - 1] = -1 - np.arange(len(order))  # no two texts share a number there
    covered = np.full(len(a), -1, dtype=np.int64)  # the last word of a run known to hold this word, the farthest
    for p in range(1, int(sizes[0]) // PERIODS + 1):
        long = int(np.searchsorted(-sizes, -max(LEAST, PERIODS * p), side="right"))
        end = int(starts[long])
        grid = a[:end:p]
        same = grid[:-1] == grid[1:]
        at = np.flatnonzero(same[:-1] & same[1:]) * p
        if not len(at):
            continue
        for offset in sorted({p // 2, p // 3, p - 1} - {0}):
            at = at[a[at + offset] == a[at + offset + p]]
        at = at[covered[at] < at + 2 * p]
        done = -1
        for i in at.tolist():
            if i < done:
                continue
            done = ahead(a[:end], i, p)
            if done <= i + p:  # the probes met by chance
                continue
            first = back(a, i, p)
            length = done - first + p
            if length >= max(LEAST, PERIODS * p):
                last = first + length - 1
                covered[first : last + 1] = np.maximum(covered[first : last + 1], last)
                text = int(np.searchsorted(starts, first, side="right")) - 1
                found[order[text]].append((first - int(starts[text]), length, p))
    for x in found:
        x.sort(key=lambda r: (r[0], r[2]))
    return found


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    ends = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        ends[start + period] += 1
        ends[start + length] -= 1
    return np.cumsum(ends[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def rolled(n: int, h: int) -> np.ndarray | None:
    """Which word stands at each place where the text of checksum h is rolled: every tenth repeats one stretch to its end."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _in_portions(rows: list[tuple[int, list[bytes]]]) -> Iterator[list[tuple[int, list[bytes]]]]:
    portion, size = [], 0
    for row in rows:
        if portion and size + len(row[1]) > WORDS:
            yield portion
            portion, size = [], 0
        portion.append(row)
        size += len(row[1])
    if portion:
        yield portion


def find(documents: DataFrame, id: str = "doc_id", text: str = "text", place: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """id, words, runs and the collapsed text (each run reduced to its first period) of every document.

    place: says from the number of words and the id's checksum which word stands at each place; None leaves the text as it is.
    """
    rows = documents.select(F.col(id).alias("id"), F.crc32(F.col(id).cast("string")).alias("checksum"), F.col(text).cast("binary").alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = kind or pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            checksums = batch.column("checksum").to_pylist()
            texts = ((k, (t.as_py() or b"").split()) for k, t in enumerate(batch.column("text")))  # bytes split at \x20 and \x09-\x0D alone
            for portion in _in_portions(texts):
                numbers: dict[bytes, int] = {}
                unused = count()
                arrays, lists = [], []
                for k, words in portion:
                    order = place(len(words), checksums[k]) if place and checksums[k] is not None else None
                    x = np.fromiter(map(numbers.setdefault, words, unused), np.int64, len(words))
                    arrays.append(x if order is None else x[order])
                    lists.append(words if order is None else [words[i] for i in order.tolist()])
                found = runs(arrays)
                collapsed = [b" ".join(w) if not r else b" ".join([w[i] for i in np.flatnonzero(kept(len(w), r)).tolist()]) for w, r in zip(lists, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array([k for k, _ in portion])),
                        pa.array([len(w) for w in lists], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], kind),
                        pa.array([None if not r else dict(zip(("start", "length", "period"), strongest(r), strict=True)) for r in found], kind.value_type),
                        pa.array(collapsed, pa.binary()),
                    ],
                    ["id", "words", "runs", "strongest", "collapsed"],
                )

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(scanned, f"id {kind}, words long, runs {RUN}, strongest struct<start:long,length:long,period:long>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string")).withColumnRenamed("id", id)


def run_digests(documents: DataFrame) -> DataFrame:
    """Of every document the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return find(documents, place=rolled).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[k].alias(k) for k in ("start", "length", "period")],
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
