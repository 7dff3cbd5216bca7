"""The pipeline's stages, each on the output of the one before it, and as one run."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    import corpus_pipeline

    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs)
    return out


def test_columns_stay_until_the_last_stage(stages):
    for name, (before, after) in stages.items():
        if name != "mix":
            assert after.columns == before.columns


def test_each_stage_decides(stages, spark, data):
    from tideline.llm import dart_minhash, decontaminate, pii

    before, after = stages["quality"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good, kept = (d.join(labels.where("quality = 1"), "doc_id").count() for d in (before, after))
    assert kept >= 0.97 * good and after.count() < before.count()
    before, after = stages["near_dedup"]
    assert after.count() == dart_minhash.classes(before).select("class_id").distinct().count() < before.count()
    assert dart_minhash.classes(after).where("class_size > 1").count() == 0
    before, after = stages["decontaminate"]
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontaminate.leaks(after, bench).count() == 0 and after.count() < before.count()
    before, after = stages["pii"]
    assert after.count() == before.count() and all(not pii.base_spans(r.text) for r in after.collect())
    before, after = stages["mix"]
    assert after.where("copies < 1 or taken > 3 * size").count() == 0
    assert after.agg(F.sum("taken")).first()[0] > 0


def test_run_gives_the_same_rows(spark, data, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, data)
    last = stages["mix"][1]
    assert sorted(got.select("doc_id", "copies", "text").collect()) == sorted(last.select("doc_id", "copies", "text").collect())


def test_awkward_rows_and_clashing_columns_pass_all_stages(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = docs.where("length(text) > 500").orderBy("doc_id").first().text
    odd = [(None, text, "en", None, 9), (None, text, "en", None, 9), (10**9, None, None, "s", None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, " \n\t ", "en", "s", 4), (10**9 + 3, text, "en", "s", len(text)), (10**9 + 3, text, "en", "s", len(text)), (10**9 + 4, text + " one", "en", "t", 1)]
    names = ("md5", "row", "leaking", "quality_score", "class_id", "node", "key", "turn")
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for i, name in enumerate(names):
        rows = rows.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        stage(spark, rows, data).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert rows.columns == before.columns
            assert rows.agg(*[F.min(n).alias(n) for n in names]).first() == rows.agg(*[F.max(n).alias(n) for n in names]).first()
        if name == "near_dedup":  # of the same text five times one row stays, whichever of those without id or with an id twice
            assert rows.where(F.col("text").isin(text, text + " one")).count() == before.where(F.col("text").isin(text, text + " one")).limit(1).count()
        empty = stage(spark, before.limit(0), data)
        assert empty.count() == 0 and (name == "mix" or empty.columns == before.columns)
