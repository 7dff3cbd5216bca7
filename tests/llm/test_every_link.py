"""No link between nodes that share a bucket is left out, however many the bucket holds."""

import numpy as np
import pandas as pd
import pytest

from tideline.llm import dart_minhash


def components(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("chunk", [1024, 40])
def test_links_that_no_pivot_shows(spark, monkeypatch, chunk):
    monkeypatch.setattr(dart_minhash, "CHUNK", chunk, raising=False)
    rng, sets = np.random.default_rng(4), {}
    for k in range(60):  # pairs about the similarity, of sizes on both sides of a power of two, all in one bucket
        size = int(rng.integers(50, 80))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size - int(rng.integers(0, 9))], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.uint64)]))
        sets[2 * k + 1], sets[2 * k + 2] = a, b
    similar = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8]
    assert 20 < len(links) < 60
    keyed = spark.createDataFrame(pd.DataFrame({"key": 7, "node": list(sets)}))
    arrays = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "node long, regions binary")
    got = {r.node: r.root for r in dart_minhash.linked(keyed, arrays).collect()}
    assert got == components(links, sets)


def test_sketches_never_rule_a_link_out():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        whole = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a = whole[:n]
        b = np.unique(np.concatenate([a[: n - int(rng.integers(0, n // 4 + 1))], whole[n : n + int(rng.integers(0, n // 4 + 1))]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = [p for p in dart_minhash.possible(np.array([1, 2]), np.array([len(a), len(b)]), [dart_minhash.sketch(a), dart_minhash.sketch(b)], 0.8) if len(p[0])]
        assert got or j < 0.8
