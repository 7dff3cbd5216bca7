"""Append-only quote logs over Structured Streaming: admission by event time, and change-or-heartbeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import changed

LOG = "key long, id long, ts_us long, value double"


def admitted(quotes: DataFrame, ts_us: Column, starts_us: Column, before_hours: int = 60, after_hours: int = 4) -> DataFrame:
    """Quotes taken from so long before an event starts until so long after."""
    hour = 3_600_000_000
    return quotes.where(ts_us.between(starts_us - before_hours * hour, starts_us + after_hours * hour))


def change_log(quotes: DataFrame, heartbeat: int = 600_000_000, tolerance: float = 0.0) -> DataFrame:
    """key, id, ts_us, value of the quotes that differ from the last one written, or come a heartbeat after it.

    The state of a key is the last written quote. A micro-batch's quotes of a key count in order of
    time; one older than the last written is late and is dropped. A key's state is
    one quote and stays, so that a heartbeat is never written twice.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts_us", "id"], kind="stable")
        last, kept = (tuple(state.get) if state.exists else None), []
        for ts, value in zip(rows["ts_us"], rows["value"], strict=True):
            keep = not (last and ts < last[0]) and changed(last, ts, value, heartbeat, tolerance)
            last = (ts, value) if keep else last
            kept.append(keep)
        if last is not None:
            state.update((int(last[0]), float(last[1])))
        yield rows[kept][["key", "id", "ts_us", "value"]]

    rows = quotes.select("key", "id", "ts_us", "value")
    return rows.groupBy("key").applyInPandasWithState(step, LOG, "ts_us long, value double", "append", GroupStateTimeout.NoTimeout)


def settled_totals(readings: DataFrame, now_us: Column, delay_hours: float = 2.5, most: int = 40) -> DataFrame:
    """readings with total, of those that can no longer change: seen, and by now, so long after kick-off.

    readings: kick_off, seen (microseconds), home, away; counts below 0 or beyond `most` together go.
    """
    delay = int(delay_hours * 3_600_000_000)
    total = F.col("home") + F.col("away")
    sound = (F.col("home") >= 0) & (F.col("away") >= 0) & (total <= most)
    return readings.where(sound & (F.col("seen") >= F.col("kick_off") + delay) & (now_us >= F.col("kick_off") + delay)).withColumn("total", total)


def upgraded(records: DataFrame, key: str, at: str, recommended: str) -> DataFrame:
    """One record a key: the first, unless it only observes and a later one recommends; then the first of those. Later ones change nothing."""
    one = F.struct(at, *[c for c in records.columns if c != at])
    first, better = F.min(one).alias("f"), F.min(F.when(F.col(recommended), one)).alias("r")
    g = records.groupBy(key).agg(first, better)
    kept = F.when(F.col(f"f.{recommended}") | F.col("r").isNull(), F.col("f")).otherwise(F.col("r"))
    return g.select(kept.alias("k")).select("k.*").select(*records.columns)


def archived(stream: DataFrame, identity: list[str], ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose identity has not been archived before; with a time column the state forgets identities that are `late` old."""
    return stream.dropDuplicates(identity) if ts is None else stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def windowed_counts(quotes: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window start, kind, n, mean of each closed window; quotes later than `late` are dropped."""
    g = quotes.withWatermark(ts, late).groupBy(F.window(ts, width), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "kind", "n", "mean")


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Writes what is available to a folder as Parquet, exactly once a checkpoint, and returns the folder's rows."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def read_landing(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the JSON files that arrive in a folder; lines that do not parse have a null key and go."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder).where("key is not null")
