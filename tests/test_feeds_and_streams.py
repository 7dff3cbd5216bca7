"""Files of many layouts, joins and quantiles at their edges, and what is said of streams, over streams."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import joins
from tideline.sources import matches, readers
from tideline.streaming import quotes as streams


def test_files_of_differing_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Team,Odds,Odds\nAlpha,2.1,2.2,,,\n,,,\n \n\"Be,ta\",1.5\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('﻿"Odds","Te""am, x",Team\n3,y,Gamma\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("Team,Other\n")
    got = readers.ragged_csv(spark, str(tmp_path))
    assert set(got.columns) == {"Team", "Odds", "Odds.1", 'Te"am, x', "Other"}
    rows = sorted(map(tuple, got.select("Team", "Odds", "`Odds.1`", F.col('`Te"am, x`'), "Other").collect()), key=str)
    assert rows == [("Alpha", "2.1", "2.2", None, None), ("Be,ta", "1.5", None, None, None), ("Gamma", "3", None, "y", None)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert readers.ragged_csv(spark, str(tmp_path / "none")).count() == 0


def test_a_large_file_keeps_its_first_line_as_header(spark, tmp_path):
    (tmp_path / "E0_2526.csv").write_text("Div,Date,HomeTeam,AwayTeam,HC,AC\n" + "".join(f"E0,01/02/2026,T{i},U,{i % 9},1\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = matches.seasons(readers.season_files(readers.file_lines(spark, str(tmp_path))), ["E0"])
        assert got.count() == 60_000 and got.select("Season", "Division", "Date").distinct().collect()[0][0] == "2025/26"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_wanted_division_without_matches_is_an_error(spark, tmp_path):
    (tmp_path / "E0_9900.csv").write_text("Div,Date,HomeTeam,AwayTeam,HC,AC\nE0,01/02/2000,A,B,3,1\nE1,01/02/2000,A,B,3,1\nE0,,A,B,3,1\n")
    lines = readers.file_lines(spark, str(tmp_path))
    got = matches.seasons(readers.season_files(lines), ["E0"]).collect()
    assert [(r.Division, r.Season, r.HC) for r in got] == [("E0", "1999/00", 3)]
    with pytest.raises(ValueError, match="no match of SP1"):
        matches.seasons(readers.season_files(lines), ["E0", "SP1"])
    with pytest.raises(ValueError, match="no file has"):
        matches.seasons(readers.season_files(lines.where("value not like 'Div%'")), ["E0"])


def test_quantiles_between_clusters_bring_few_values_to_the_driver(spark, monkeypatch):
    n = 60_000
    rows = spark.range(2 * n).select((F.when(F.col("id") < n, 0.0).otherwise(1e9) + F.col("id") % n / 1e3).alias("v"))
    brought = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: brought.append(out := collect(self)) or out)
    assert joins.quantile(rows, "v", 0.5) == pytest.approx(((n - 1) / 1e3 + 1e9) / 2, rel=1e-12)
    assert max(map(len, brought)) <= 2001


def test_quantiles_of_nulls_nan_and_infinities(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (2.0,)], "v double")
    assert joins.quantile(rows, "v", 0.5) == 2.0 and joins.quantile(rows, "v", 1.0) == 1e308
    assert joins.quantile(rows.limit(2), "v", 0.5) is None


def test_rows_beside_each_other_with_null_keys(spark):
    left = spark.createDataFrame([(1, 1, None), (2, None, 5), (3, 1, 5), (4, 9, 9), (5, None, None), (6, 1, 5)], "id long, a long, b long")
    right = spark.createDataFrame([(1, None, "x"), (None, 5, "y"), (1, 5, "z"), (None, None, "w")], "a long, b long, v string")
    got = {r.id: r.v for r in joins.beside(left, right, ["a", "b"]).collect()}
    assert got == {1: "x", 2: "y", 3: "z", 4: None, 5: "w", 6: "z"}
    plan = joins.beside(left, right, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "((a#" in plan and plan.count("<=>") == 2  # null-safe on the rows with null keys alone


def test_what_is_known_is_carried_over_buckets(spark):
    r = random.Random(5)
    rows = [(k, t, i, r.choice([None, None, float(i)]), r.choice([None, i])) for i, (k, t) in enumerate((r.choice([1, 2, None]), r.randrange(60)) for _ in range(300))]
    frame = spark.createDataFrame(rows, "k long, t long, id long, v double, w long").repartition(4)
    got = {x.id: (x.last_v, x.big) for x in joins.carried(frame, ["k"], F.floor(F.col("t") / 7), ["t", "id"], {"last_v": F.col("v"), "big": F.when(F.col("w") > 50, F.col("w"))}).collect()}
    for key in (1, 2, None):
        v = w = None
        for _, t, i, a, b in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            v, w = a if a is not None else v, b if b is not None and b > 50 else w
            assert got[i] == (v, w)
    out = joins.carried(frame, ["k"], F.floor(F.col("t") / 7), ["t", "id"], {"last_v": F.col("v")})
    assert out.columns == [*frame.columns, "last_v"] and joins.carried(frame.limit(0), ["k"], F.floor("t"), ["t"], {"x": F.col("v")}).count() == 0


# streams ------------------------------------------------------------------------------------------

QUOTES = "key long, kind string, ts timestamp, value double, at long, flag boolean"


def landing(spark, tmp_path, *parts):
    """Files that arrive one after another, one a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, QUOTES.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
    return spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "landing"))


def streamed(spark, tmp_path, out, name, mode):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def quote(key, ts, value=1.0, at=0, flag=False, kind="view"):
    return key, kind, f"2025-01-01 {ts}", value, at, flag


def test_late_quotes_miss_their_window(spark, tmp_path):
    stream = landing(spark, tmp_path, [quote(1, "10:05:00", 2.0), quote(1, "10:50:00", 4.0)], [quote(1, "12:30:00")], [quote(1, "12:31:00")], [quote(1, "10:55:00", 100.0), quote(1, "12:35:00", 4.0)], [quote(1, "15:00:00")], [quote(1, "15:01:00")])
    got = {str(r.start)[11:13]: (r.n, r["mean"]) for r in streamed(spark, tmp_path, streams.windowed_counts(stream, "ts"), "windows", "append")}
    assert got == {"10": (2, 3.0), "12": (3, 2.0)}  # 10:55 came after 12:30 less ten minutes; the window of 15 is still open


def test_what_is_archived_once_is_not_archived_again(spark, tmp_path):
    stream = landing(spark, tmp_path, [quote(1, "10:00:00"), quote(1, "10:00:00"), quote(2, "10:00:00")], [quote(1, "10:30:00"), quote(3, "10:30:00")])
    got = streamed(spark, tmp_path, streams.archived(stream, ["key", "kind"]), "archive", "append")
    assert sorted(r.key for r in got) == [1, 2, 3]


def test_an_archive_with_a_watermark_forgets_old_identities(spark, tmp_path):
    stream = landing(spark, tmp_path, [quote(1, "10:00:00")], [quote(1, "10:20:00")], [quote(2, "15:00:00")], [quote(2, "15:01:00")], [quote(1, "15:02:00")])
    got = streamed(spark, tmp_path, streams.archived(stream, ["key"], "ts", "1 hour"), "forgetful", "append")
    assert sorted((r.key, str(r.ts)[11:16]) for r in got) == [(1, "10:00"), (1, "15:02"), (2, "15:00")]


def test_a_recorded_forecast_is_upgraded_once(spark, tmp_path):
    stream = landing(spark, tmp_path, [quote(1, "10:00:00", 1.0, 1), quote(2, "10:00:00", 1.0, 1, True)], [quote(1, "11:00:00", 2.0, 2, True), quote(2, "11:00:00", 2.0, 2, True)], [quote(1, "12:00:00", 3.0, 3, True)])
    columns = stream.select("key", "at", "value", "flag")
    got = streamed(spark, tmp_path, streams.upgraded(columns, "key", "at", "flag"), "upgrades", "complete")
    assert {r.key: r.value for r in got} == {1: 2.0, 2: 1.0}


def test_totals_settle_after_the_delay(spark, tmp_path):
    hour = 3_600_000_000
    stream = landing(spark, tmp_path, [quote(1, "10:00:00", at=0), quote(2, "10:00:00", at=4 * hour)], [quote(3, "10:00:00", at=3 * hour)])
    readings = stream.select("key", F.lit(0).alias("kick_off"), F.col("at").alias("seen"), F.lit(3).alias("home"), F.lit(4).alias("away"))
    got = streamed(spark, tmp_path, streams.settled_totals(readings, F.lit(5 * hour)), "totals", "append")
    assert sorted((r.key, r.total) for r in got) == [(2, 7), (3, 7)]
