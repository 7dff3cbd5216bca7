"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S wants every document T / S times: the whole part is certain, the
fraction is a copy probability. Fractions are rounded dependently: within a block of documents of
one source and size octave, two fractional documents exchange probability mass, weighted by their
sizes, until one of them is 0 or 1; the words expected from the pair stay the same. The few that a
block leaves fractional go up a reduction tree over blocks, and the octaves' last ones meet at the
source's root, largest first, where each passes what it took too much or too little on to all those
after it. A source therefore ends within about the size of a small document of its target.

Defined cases: a null text has size 0 and is taken 0 times in words; a null source is a source of
its own, ordered last; a source of size 0 has target 0; rows that repeat an id are drawn one by one
(unit="row") or together (unit="key"); random numbers are hashes of the row and a seed, so reruns
agree; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, spool

#: Rows of a leaf block; rows that a block or node leaves fractional; children of a node of the tree.
BLOCK, LEFT, FAN_IN = 512, 24, 32

STATE = "id long, known boolean, src long, octave int, block long, size double, p double, whole int, u double, key long, m long"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """src (number by code point, null last), source, source_size, target, documents of each source.

    sizes: source, size. Targets share all words by weight; one that would exceed `most` times its
    source's size stops there and the excess is reshared: with the sources ordered by how soon they
    stop, the first that does not stop sets the level for all, which one running sum finds. One row a source is ordered here, never the documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    totals = totals.select("*", number.cast("long").alias("src"))
    totals = totals.select("*", F.get(weights, (F.col("src") - 1) % len(cycle)).alias("weight"))
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before, after = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    totals = totals.select("*", level.alias("level"))
    stops = F.col("weight") * F.col("level") > most * F.col("source_size")
    totals = totals.select("*", F.max(F.when(~stops, F.col("level"))).over(everything).alias("final"))
    return totals.select(
        "src",
        "source",
        "source_size",
        F.least(F.col("weight") * F.coalesce("final", F.lit(math.inf)), most * F.col("source_size")).alias("target"),
        "docs",
    )


def _uniform(*columns: Column | str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _pivot(block: pd.DataFrame) -> pd.DataFrame:
    """Rounds all but LEFT of a block's fractional rows; the words p * size of the block stay the same."""
    block = block.sort_values(["size", "key", "u"], ascending=[False, True, True], kind="stable")
    p, size, u = (block[c].to_numpy(dtype=float, copy=True) for c in ("p", "size", "u"))
    held, left = -1, int(((p > 0) & (p < 1)).sum())
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if left <= LEFT:
            break
        if held < 0:
            held = i
            continue
        up = min((1 - p[held]) * size[held], p[i] * size[i])
        down = min(p[held] * size[held], (1 - p[i]) * size[i])
        moved = up if u[i] * (up + down) < down else -down
        p[held] += moved / size[held]
        p[i] -= moved / size[i]
        for j in (held, i):
            p[j] = 0.0 if p[j] < 1e-9 else 1.0 if p[j] > 1 - 1e-9 else p[j]
        still = [j for j in (held, i) if 0 < p[j] < 1]
        left -= 2 - len(still)
        held = still[0] if still else -1
    return block.assign(p=p)


def _root(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds a source's last fractional rows, largest first; what one misses is spread over all that follow.

    Chance decides wherever the rows that follow can make up for either outcome, else the outcome that they can.
    """
    rows = rows.sort_values(["size", "key", "u"], ascending=[False, True, True], kind="stable")
    p, size, u = (rows[c].to_numpy(dtype=float, copy=True) for c in ("p", "size", "u"))
    rest = np.cumsum(size[::-1])[::-1]
    mass = np.append(np.cumsum((p * size)[::-1])[::-1], 0.0)  # words that the rows from i on are expected to take
    missed = 0.0
    for i in range(len(p)):
        short, over = missed + p[i] * size[i], missed + (p[i] - 1) * size[i]
        excess = max(0.0, -over - mass[i + 1]), max(0.0, short - (rest[i] - size[i] - mass[i + 1]))
        if excess[0] != excess[1]:
            taken = float(excess[0] < excess[1])
        else:
            taken = float(u[i] < p[i] + missed / rest[i])
        missed = over if taken else short
        p[i] = taken
    return rows.assign(p=p)


def copies(
    rows: DataFrame, targets: DataFrame, seed: int = 7, unit: str = "row", block: int = BLOCK
) -> DataFrame:
    """id, src, key, size, m, copies: how often each row is taken. rows: id, source, size, key.

    unit="row": rows equal in all four columns are drawn one by one; "key": together, m at a time.
    """
    targets = F.broadcast(targets) if small(targets) else targets
    units = rows.groupBy("id", "source", "size", "key").agg(F.count("*").alias("m"))
    units = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    if unit == "row":
        units = units.select("*", F.explode(F.sequence(F.lit(1), "m")).alias("nth")).withColumn("m", F.lit(1).cast("long"))
    else:
        units = units.select("*", F.lit(1).alias("nth"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    weight = (F.col("size") * F.col("m")).cast("double")
    state = units.select(
        F.coalesce("id", F.lit(0)).alias("id"),  # pandas would make doubles of ids beside a null
        F.col("id").isNotNull().alias("known"),
        "src",
        F.when(weight > 0, F.floor(F.log2(weight))).otherwise(-1).cast("int").alias("octave"),
        F.pmod(F.xxhash64("id", "key", "nth", F.lit(seed)), F.ceil(F.col("docs") / block)).alias("block"),
        weight.alias("size"),
        F.when(weight > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
        F.floor(rate).cast("int").alias("whole"),
        _uniform("id", "key", "nth", F.lit(seed + 1)).alias("u"),
        "key",
        "m",
    )
    blocks = targets.agg(F.ceil(F.max("docs") / block)).first()[0] or 1
    done, fractional = [], "p > 0 and p < 1"
    while True:
        state = spool(state.groupBy("src", "octave", "block").applyInPandas(_pivot, STATE), "pivotal")
        done.append(state.where(f"not ({fractional})"))
        state = state.where(fractional).withColumn("block", F.floor(F.col("block") / FAN_IN))
        if blocks <= 1:
            break
        blocks = math.ceil(blocks / FAN_IN)
    done.append(state.groupBy("src").applyInPandas(_root, STATE))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.when(F.col("known"), F.col("id")).alias("id"), "src", "key", (F.col("size") / F.col("m")).cast("long").alias("size"), "m",
        (F.col("whole") + F.col("p")).cast("int").alias("copies"),
    )


def mix(documents: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    rows = documents.select(F.col("doc_id").alias("id"), "source", words(F.col("text")).alias("size"), F.lit(0).cast("long").alias("key"))
    rows = spool(rows, "sizes")
    targets = spool(source_targets(rows), "targets")
    drawn = copies(rows, targets, seed)
    targets = F.broadcast(targets) if small(targets) else targets
    return drawn.join(targets, "src").select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


def mixed(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, whole, with size, source_size, target, copies and taken.

    Rows equal in id, source and text are one unit here and get the same number of copies.
    """
    key = {"mix_size": words(F.col("text")), "mix_key": F.xxhash64(F.coalesce("text", F.lit("")))}
    columns = documents.columns
    if clash := {*columns} & {*key, "size", "source_size", "target", "copies", "taken"}:
        documents = documents.drop(*clash)
        columns = documents.columns
    rows = documents.withColumns(key)
    units = spool(rows.select(F.col("doc_id").alias("id"), "source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key")), "sizes")
    targets = spool(source_targets(units), "targets")
    drawn = spool(copies(units, targets, seed, unit="key").where("copies > 0"), "drawn")
    targets = F.broadcast(targets) if small(targets) else targets
    drawn = drawn.join(targets, "src").select(
        F.col("id").alias("u_id"), F.col("source").alias("u_source"), F.col("key").alias("u_key"), "size", "source_size", "target", "copies"
    )
    same = F.col("doc_id").eqNullSafe(F.col("u_id")) & F.col("source").eqNullSafe(F.col("u_source")) & (F.col("mix_key") == F.col("u_key"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.join(drawn, same).select(*columns, "size", "source_size", "target", "copies", taken)
