"""Writers that keep what is already there honest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, one a key; null-safe keys. A key whose rows differ between or within them raises."""
    columns = old.columns
    rows = old.select(*columns).unionByName(new.select(*columns))
    rest = F.xxhash64(*columns)
    g = rows.groupBy(*keys).agg(F.min(rest).alias("__a"), F.max(rest).alias("__b"), F.first(F.struct(*columns)).alias("__r"))
    wrong = F.concat(F.lit("conflicting rows for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("__a") == F.col("__b"), F.col("__r")).otherwise(F.raise_error(wrong).cast(rows.select(F.struct(*columns)).schema[0].dataType))
    return g.select(checked.alias("__r")).select("__r.*")


def newest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key: a new one replaces an old one only if it is strictly newer."""
    columns = old.columns
    rows = old.select(F.lit(1).alias("__old"), *columns).unionByName(new.select(F.lit(0).alias("__old"), *columns))
    best = F.max(F.struct(F.col(at).alias("__at"), "__old", F.struct(*columns).alias("__r"))).alias("__m")
    return rows.groupBy(*keys).agg(best).select("__m.__r.*")


def publish_json(rows: DataFrame, folder: str, files: int | None = None) -> None:
    """rows as gzipped JSON lines; Spark's commit makes a folder appear whole or not at all, and replaces an earlier one."""
    (rows if files is None else rows.repartition(files)).write.mode("overwrite").option("compression", "gzip").json(folder)


def publish_csv(rows: DataFrame, folder: str) -> None:
    """rows as CSV files, each with the header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def versioned(rows: DataFrame, places: int = 6, digits: int = 20) -> DataFrame:
    """payload, version: each row as JSON with its decimals rounded, and the head of its hash."""
    rounded = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    out = rows.select(F.to_json(F.struct(*rounded)).alias("payload"))
    return out.withColumn("version", F.substring(F.sha2("payload", 256), 1, digits))


def checksums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, checksum of a table, whatever the order of its rows: what a backup is compared by."""
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("checksum"))
