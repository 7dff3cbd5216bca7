"""Regions are written for nodes that share a bucket only, and once for each."""

import numpy as np
import pytest

from tideline.llm import dart_minhash

SCHEMA = "doc_id long, text string"


def prose(rng, n=300):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def test_only_nodes_of_shared_buckets_have_regions_on_disk(spark, monkeypatch):
    rng, written, spool = np.random.default_rng(6), {}, dart_minhash.spool

    def watched(df, name):
        out = spool(df, name)
        if "regions" in out.columns:
            written[name] = [r.n for r in out.selectExpr("length(regions) AS n").collect()]
        return out

    monkeypatch.setattr(dart_minhash, "spool", watched)
    near, again = prose(rng), prose(rng)
    rows = [(k, prose(rng)) for k in range(40)] + [(100, near), (101, near + " end"), (102, near.upper())]
    # texts that repeat with their id, or without any
    rows += [(None, again), (None, again), (None, again), (103, again + " end"), (103, again + " end"), (104, None), (None, " ")]
    got = dart_minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.class_size) for r in got if r.class_size > 1)
    assert sizes == [(False, 100, 3), (False, 101, 3), (False, 102, 3), (False, 103, 5), (False, 103, 5)] + 3 * [(True, 0, 5)]
    assert len(got) == len(rows) and sum(r.is_kept for r in got) == 40 + 2 + 2
    assert {k: len(x) for k, x in written.items()} == {"held": 4}  # two groups of two different texts
    assert sum(written["held"]) < 4 * 8 * 300


def test_documents_that_change_between_readings_are_refused(spark):
    members = dart_minhash.spool(spark.createDataFrame([(7, 1), (7, 2)], "key long, node long"), "buckets")
    with pytest.raises(ValueError, match="two readings"):
        dart_minhash.grown(members, spark.createDataFrame([(1, bytearray(b"12345678"))], "node long, regions binary"))
