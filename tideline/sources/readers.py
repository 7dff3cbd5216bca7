"""Readers over a landing zone: ragged CSV with repeated headers, nested quote payloads, draw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Heads are broadcast only after they have been counted.
BROADCAST_FILES = 10_000

PAYLOAD = "array<struct<id:string,pools:array<struct<type:string,lines:array<struct<line:string,status:string,combos:array<struct<side:string,odds:string>>>>>>>>"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, value: the lines of text files; at orders the lines of a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def ragged_lines(lines: DataFrame) -> DataFrame:
    """file, and the columns of all files by name, all text: CSV files of differing layouts as one table.

    lines: file, at, value. A file's first line is its header (a byte-order mark goes, names may be quoted); a name
    that it repeats gets .1, .2, ...; rows are cut or padded with null, as are columns that a file does not have;
    rows without anything but blanks go. Values do not span lines.
    """
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where("value is not null")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first")).persist()  # a row a file
    plain = F.regexp_replace("head", '"[^"]*"', "")
    heads = heads.withColumn("width", F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1)
    widest = heads.agg(F.max("width")).first()[0]
    if widest is None:
        return lines.select("file")
    fields = ", ".join(f"c{i} string" for i in range(widest))
    cells = lambda c: F.from_csv(c, F.lit(fields), {"mode": "PERMISSIVE", "escape": '"'})
    listed = lambda r: F.array(*[F.col(f"{r}.c{i}") for i in range(widest)])
    names = F.transform(F.slice(listed("r"), F.lit(1), F.col("width")), lambda n: F.coalesce(n, F.lit("")))
    heads = heads.select("file", "first", "width", cells("head").alias("r")).select("file", "first", names.alias("names"))
    seen = lambda n, i: F.size(F.filter(F.slice("names", F.lit(1), i), lambda x: x == n))
    unique = F.transform("names", lambda n, i: F.when(seen(n, i) > 0, F.concat_ws(".", n, seen(n, i).cast("string"))).otherwise(n))
    heads = heads.select("file", "first", unique.alias("names")).persist()
    # one row a column of any file
    known = heads.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()
    if heads.count() <= BROADCAST_FILES:  # else a file's lines meet its head where they lie, which makes a task of a large file
        heads = F.broadcast(heads)
    rows = lines.join(heads, "file").where((F.col("at") != F.col("first")) & (F.regexp_replace("value", r'[,"\s]', "") != ""))
    values = F.transform("names", lambda n, i: F.get("cells", i))
    rows = rows.select("file", "names", cells("value").alias("r")).select("file", "names", listed("r").alias("cells"))
    # an explode of one: what is asked of the columns later is not asked before it, which would read a line anew for each cell
    rows = rows.select("file", F.explode(F.array(F.map_from_arrays("names", values))).alias("m"))
    return rows.select("file", *[F.try_element_at("m", F.lit(k.name)).alias(k.name) for k in known])


def ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """ragged_lines() of the files of a path."""
    return ragged_lines(file_lines(spark, path)).drop("file")


def season_files(lines: DataFrame) -> DataFrame:
    """ragged_lines() of files named <division>_<season>.csv (E0_2425.csv), with __division and __season (2024/25); other files go."""
    rows = ragged_lines(lines)
    part = lambda k: F.regexp_extract("file", r"(?:^|/)([A-Z]+[0-9]*)_(\d\d)(\d\d)\.csv$", k)
    century = F.when(part(2).try_cast("int") >= 69, "19").otherwise("20")
    return rows.where(part(1) != "").select("*", part(1).alias("__division"), F.concat(century, part(2), F.lit("/"), part(3)).alias("__season")).drop("file")


def flat_quotes(payloads: DataFrame, column: str = "payload", kinds: tuple[str, ...] = ("CHL", "HAD")) -> DataFrame:
    """id, type, line, status, side, odds of each combination of the kinds asked for whose odds are a number above 0; level by level."""
    pools = payloads.select(F.inline(F.from_json(column, PAYLOAD))).select("id", F.inline("pools")).where(F.col("type").isin(*kinds))
    lines = pools.select("id", "type", F.inline("lines"))
    sides = lines.select("id", "type", "line", "status", F.inline("combos")).withColumn("odds", F.col("odds").try_cast("double"))
    return sides.where("odds > 0")


def draw_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """label, numbers, error of lines `label,n,n,n,n,n,n`; error is null where six distinct numbers lie in 1..49."""
    cells = F.split(column, ",")
    numbers = F.transform(F.slice(cells, 2, 6), lambda c: F.trim(c).try_cast("int"))
    error = F.when(F.size(cells) < 7, "too few fields").when(F.exists(numbers, lambda n: n.isNull()), "not a number").when(F.exists(numbers, lambda n: (n < 1) | (n > 49)), "out of range").when(F.size(F.array_distinct(numbers)) < 6, "repeated number")
    return lines.select(F.get(cells, F.lit(0)).alias("label"), F.array_sort(numbers).alias("numbers"), error.alias("error"))


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "dd/MM/yy")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")
