"""Rows that the supplied tables hold seldom or not at all."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import joins, models
from tideline.queries import QUERIES
from tideline.sources import readers


def test_two_way_prices_of_one_and_none(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, None), (3, 50.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: tuple(r)[1:] for r in QUERIES["q_two_way_fair"](spark, str(tmp_path)).collect()}
    assert got[1] == (0.962963, 0.037037, 1.038462, False)
    assert got[2] == (None, None, None, None)
    assert got[3][3] is True


def test_a_book_of_exactly_one_is_not_over_full(spark, tmp_path):
    rows = [(7, q, 0.05) for q in (1.0, 44.0, 2.0, 8.0, 29.0)] + [(8, 0.5, 0.05), (8, 1.0, 0.05)]  # 1/2 + 1/45 + 1/3 + 1/9 + 1/30; 2/3 + 1/2
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.race: (r.book, r.violations) for r in QUERIES["q_contract_violations"](spark, str(tmp_path)).collect()}
    assert got == {7: (1.0, ""), 8: (1.166667, "over full")}


def test_rows_of_a_day_make_no_pairs(spark):
    left = [(i, i % 3, 10 + i % 4) for i in range(60)]
    right = [(i % 3, 10 + i % 5, None if i % 7 == 0 else float(i)) for i in range(0, 60, 2) if i % 5 != 1]
    l, r = spark.createDataFrame(left, "id long, k long, d long"), spark.createDataFrame(right, "k long, d long, v double")
    out = joins.by_shift(l, r, ["k"], "id", F.col("d"), F.col("d"), F.col("v"))
    want = {}
    for i, k, d in left:
        cells = [[v for k2, d2, v in right if (k2, d2) == (k, d + s)] for s in (0, -1, 1)]
        cell = next((c for c in cells if c), [])
        want[i] = min((v for v in cell if v is not None), default=None)
    assert {x.id: x.value for x in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3  # both sides are one row a key and day before they meet


def test_lag_correlations_over_blocks(spark):
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(-40, 200, 180))  # gaps and steps that come twice
    x = rng.integers(6, 280, 180)
    got = {r.lag: r for r in joins.lag_correlations(spark.createDataFrame([(int(a), int(b)) for a, b in zip(at, x, strict=True)], "at long, x long"), "at", "x", range(3, 31), block=32).collect()}
    for lag in range(3, 31):
        pairs = np.array([(x[i], x[j]) for i in range(180) for j in range(180) if at[j] == at[i] + lag])
        assert got[lag].n == len(pairs) and abs(got[lag].r - np.corrcoef(pairs.T)[0, 1]) < 1e-9


def test_lines_of_files_are_read_once_and_meet_their_heads_without_a_shuffle(spark):
    lines = spark.createDataFrame([("E0_2425.csv", 0, "Div,HC"), ("E0_2425.csv", 1, "E0,4")], "file string, at long, value string")
    rows = readers.season_files(lines).where("HC > 3 and Div = 'E0' and HC < 9")
    assert [tuple(r) for r in rows.collect()] == [("E0", "4", "E0", "2024/25")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "broadcast" in plan.lower()


def test_windows_over_kept_groups_do_not_sort_again(spark):
    rows = models.together(spark.range(1000).selectExpr("id % 50 AS race", "id * 1.0D AS x"), "race")
    out = rows.withColumn("s", F.sum("x").over(Window.partitionBy("race"))).agg(F.sum("s"))
    assert out.first()[0] == 20 * 999 * 500.0
    plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Window" in plan and "Sort [" not in plan and "Exchange hash" not in plan
    rows.unpersist()
