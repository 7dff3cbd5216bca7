"""Exact top-k search by inner product with MaxScore.

The dimensions of a vector are its terms, a component the term's impact. In a shard of vectors every
term has an upper and a lower bound of what it can add to a query's score. Terms are split by these
bounds: the non-essential ones are those with the narrowest ranges that together cannot lift any
vector over the score of the current k-th best. The essential terms are traversed for the whole
shard; the others are probed, a few terms at a time, only for vectors that can still compete. The
shards' best are merged to the k best of each query, ties to the smaller id.

Vectors are dealt to shards of bounded size and queries to blocks of bounded size; every block
meets every shard in a task of its own, so no task holds all vectors or all queries.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an
id, take no part; vectors of different lengths are compared as if padded with zeros; rows that
repeat an id or a vector are rows of their own, and a query's own row alone is no candidate of it;
fewer candidates than k give fewer rows; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: Vectors of a shard, queries of a block, terms probed between two prunings.
SHARD, QUERIES, PROBE = 4096, 512, 8

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a double; null for vectors that take no part."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((width, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def search_shard(
    ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, query: np.ndarray, own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best columns of terms (width x vectors), own row left out; exact."""
    n = terms.shape[1]
    alive = np.flatnonzero(rows != own)
    if not len(alive):
        return alive, np.zeros(0, dtype=terms.dtype)
    ends = np.stack([query * terms.min(axis=1), query * terms.max(axis=1)])
    low, reach = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
    order = np.argsort(-reach, kind="stable")  # widest range first
    tail = np.append(np.cumsum(reach[order][::-1])[::-1], 0)  # what the terms from i on can add
    base = low.sum()
    seed = alive[: max(4 * k, 64)]
    scores = query @ terms[:, seed]
    bar = np.sort(scores)[::-1][k - 1] if len(seed) >= k else None
    if bar is None or len(alive) <= len(seed):
        at, got = (seed, scores) if len(alive) <= len(seed) else (alive, query @ terms[:, alive])
    else:
        split = int(np.argmax(tail < bar - base)) if (tail < bar - base).any() else len(order)
        split = max(split, 1)
        essential = order[:split]
        partial = base + (query[essential] @ terms[essential]) - low[essential].sum()
        at = alive[partial[alive] + tail[split] >= bar]
        got = partial[at]
        for i in range(split, len(order), PROBE):
            probe = order[i : i + PROBE]
            got = got + query[probe] @ terms[np.ix_(probe, at)] - low[probe].sum()
            rest = tail[min(i + PROBE, len(order))]
            if len(got) > k:
                bar = max(bar, np.partition(got, len(got) - k)[len(got) - k])  # what is left adds nothing negative
            stays = got + rest >= bar
            at, got = at[stays], got[stays]
    best = np.lexsort((rows[at], ids[at], -got))[:k]
    return at[best], got[best]


def _shard(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    if len(vectors) and len(queries):
        width = max(vectors["terms"].map(len).max(), queries["terms"].map(len).max())
        terms, asked = _matrix(vectors["terms"], width), _matrix(queries["terms"], width).T
        most = float(np.abs(terms).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1)
        kind = np.float64 if most < 2**52 else object  # doubles are exact here; beyond, Python's integers
        terms, asked = terms.astype(kind), asked.astype(kind)
        ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
        for q, row, name in zip(asked, queries["row"], queries["vec_id"], strict=True):
            at, scores = search_shard(ids, rows, terms, q, row, k)
            found += [(row, name, rows[i], ids[i], int(s)) for i, s in zip(at, scores, strict=True)]
    return pd.DataFrame(found, columns=["query_row", "query_id", "row", "vec_id", "score"])


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row that is_query selects."""
    vectors = spool(
        embeddings.where("vec_id is not null")
        .select("vec_id", quantised(F.col("embedding")).alias("terms"), is_query.alias("asks"))
        .where("terms is not null")
        .select(F.monotonically_increasing_id().alias("row"), "*"),
        "vectors",
    )
    n, asks = vectors.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asks // queries))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = vectors.select("row", "vec_id", "terms", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = vectors.where("asks").select("row", "vec_id", "terms", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    found = (
        dealt.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(lambda v, q: _shard(v, q, k), FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
