"""An exchange's stream of changes (JSON lines, plain or .bz2) as snapshots of two-way markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import corner_line, direction

CHANGE = """pt long, mc array<struct<id:string, marketDefinition:struct<eventName:string, name:string, marketType:string, marketTime:string, inPlay:boolean,
runners:array<struct<id:long, name:string>>>, rc:array<struct<id:long, ltp:double>>>>"""


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """seq, value: the lines of a folder's files, in order within each file; compressed files are read as they are."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("seq"), "value")


def snapshots(lines: DataFrame) -> DataFrame:
    """market_id, event_name, market_name, market_type, captured_at, market_time, line, over_odds, under_odds, is_closing.

    lines: seq, value. What a change leaves out keeps its last value in the market, up to that change; a
    runner keeps the side that its market's definitions give it. A snapshot needs a line, both sides' last
    prices above 1, and a time before the market's, out of play. Of one market, time and line the last
    counts; the last of a market and line is closing if the market has gone in play. A broken line has no changes.
    """
    parsed = lines.select("seq", F.from_json("value", CHANGE).alias("m")).select("seq", "m.pt", F.posexplode("m.mc").alias("at", "c"))
    d = F.col("c.marketDefinition")
    changes = parsed.select("seq", "at", "pt", F.col("c.id").alias("market_id"), *[d[f].alias(t) for f, t in (("eventName", "event_name"), ("name", "market_name"), ("marketType", "market_type"), ("marketTime", "market_time"), ("inPlay", "in_play"), ("runners", "runners"))], F.col("c.rc").alias("rc"))
    named = changes.select("market_id", "seq", "at", F.explode("runners").alias("r")).select("market_id", F.col("r.id").alias("runner"), F.struct("seq", "at").alias("t"), F.coalesce("r.name", F.col("r.id").cast("string")).alias("name"))
    names = named.groupBy("market_id", "runner").agg(F.max_by("name", "t").alias("name"))
    roles = names.select("market_id", "runner", direction(F.col("name")).alias("side")).where("side is not null")
    texts = names.groupBy("market_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))  # a market's runners: a handful
    prices = changes.select("market_id", "seq", "at", F.posexplode("rc").alias("i", "p")).select("market_id", "seq", "at", "i", F.col("p.id").alias("runner"), F.col("p.ltp").alias("price")).where("price is not null")
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.col("price")), F.when(F.col("side") == side, F.col("i"))).alias(side)
    quoted = prices.join(roles, ["market_id", "runner"]).groupBy("market_id", "seq", "at").agg(last("over"), last("under"))
    so_far = Window.partitionBy("market_id").orderBy("seq", "at").rowsBetween(Window.unboundedPreceding, 0)
    kept = ["event_name", "market_name", "market_type", "market_time", "in_play", "over", "under"]
    state = changes.drop("rc").join(quoted, ["market_id", "seq", "at"], "left")
    state = state.select("market_id", "seq", "at", "pt", F.max(F.col("runners").isNotNull()).over(so_far).alias("defined"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in kept])
    state = state.join(texts, "market_id").withColumn("line", corner_line(F.concat_ws(" ", "market_name", "names")))
    at, starts = F.timestamp_millis("pt"), F.to_timestamp("market_time")
    out: Column = (~F.coalesce("in_play", F.lit(False))) & F.col("defined") & F.col("line").isNotNull() & (F.col("over") > 1) & (F.col("under") > 1) & (at < starts)
    played = state.groupBy("market_id").agg(F.max_by("in_play", F.struct("seq", "at")).alias("played"))
    one = state.where(out).groupBy("market_id", "pt", "line").agg(F.max_by(F.struct("event_name", "market_name", "market_type", "market_time", "over", "under"), F.struct("seq", "at")).alias("s"))
    newest = F.max("pt").over(Window.partitionBy("market_id", "line"))
    return one.withColumn("newest", newest).join(played, "market_id").select(
        "market_id", "s.event_name", "s.market_name", "s.market_type", F.timestamp_millis("pt").alias("captured_at"), F.to_timestamp("s.market_time").alias("market_time"), "line",
        F.col("s.over").alias("over_odds"), F.col("s.under").alias("under_odds"), (F.coalesce("played", F.lit(False)) & (F.col("pt") == F.col("newest"))).alias("is_closing"),
    )


FOOTBALL = """data struct<matches:array<struct<id:string, kickOffTime:string, tournament:struct<nameProfileId:string>, homeTeam:struct<name_ch:string>, awayTeam:struct<name_ch:string>,
foPools:array<struct<oddsType:string, lines:array<struct<condition:string, status:string, combinations:array<struct<str:string, currentOdds:string, selections:array<struct<str:string>>>>>>>>>>>"""
RACING = """meeting struct<date:string, venueCode:string>, pools array<struct<oddsType:string, status:string, sellStatus:string, lastUpdateTime:string, leg:struct<races:array<int>>,
oddsNodes:array<struct<combString:string, oddsValue:string>>>>"""


def positive(text: Column) -> Column:
    """A number above 0, else null."""
    x = text.try_cast("double")
    return F.when(x > 0, x)


def priced(pairs: Column) -> Column:
    """A map of the pairs (name, odds) that have both; of a name twice the last."""
    good = F.filter(pairs, lambda p: p["odds"].isNotNull() & (F.coalesce(p["name"], F.lit("")) != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def football_quotes(payloads: DataFrame, profiles: dict[str, str], now: Column, column: str = "payload", before_h: int = 4, ahead_h: int = 60) -> DataFrame:
    """key, market, league, match_id, kick_off, condition, line_status, home, away, odds, minutes: one row a line with any price.

    Matches of known tournaments only, from `before_h` hours ago to `ahead_h` hours ahead; corner and
    head-to-head pools only. A kick-off that is no time leaves its match out.
    """
    m = payloads.select(F.inline(F.from_json(column, FOOTBALL)["data"]["matches"]))
    league = F.try_element_at(F.create_map(*[F.lit(x) for p in profiles.items() for x in p]), F.col("tournament.nameProfileId"))
    m = m.withColumns({"league": league, "starts": F.try_to_timestamp("kickOffTime")}).where("league is not null")
    m = m.where((F.col("starts") >= now - F.make_interval(hours=F.lit(before_h))) & (F.col("starts") <= now + F.make_interval(hours=F.lit(ahead_h))))
    pools = m.select("id", "kickOffTime", "starts", "league", F.col("homeTeam.name_ch").alias("home"), F.col("awayTeam.name_ch").alias("away"), F.explode("foPools").alias("p")).where("p.oddsType in ('CHL', 'HAD')")
    lines = pools.select("*", F.explode("p.lines").alias("l"))
    name = lambda c: F.coalesce(F.nullif(c["str"], F.lit("")), F.get(c["selections"], F.lit(0))["str"])
    odds = priced(F.transform("l.combinations", lambda c: F.struct(name(c).alias("name"), positive(c["currentOdds"]).alias("odds"))))
    minutes = F.bround((F.unix_micros("starts") - F.unix_micros(now)) / 60e6).cast("long")
    empty = F.lit("")
    return lines.withColumn("odds", odds).where(F.size("odds") > 0).select(
        F.concat_ws(":", F.lit("football"), F.coalesce("id", empty), "p.oddsType", F.coalesce("l.condition", empty)).alias("key"), F.col("p.oddsType").alias("market"), "league",
        F.coalesce("id", empty).alias("match_id"), F.col("kickOffTime").alias("kick_off"), F.col("l.condition").alias("condition"), F.col("l.status").alias("line_status"), "home", "away", "odds", minutes.alias("minutes"),
    )


def racing_quotes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """key, market, race_id, date, venue, race_no, pool_status, sell_status, updated, odds: win and place pools with any price."""
    p = payloads.select(F.from_json(column, RACING).alias("x")).select(F.coalesce("x.meeting.date", F.lit("")).alias("date"), F.coalesce("x.meeting.venueCode", F.lit("")).alias("venue"), F.inline("x.pools"))
    race = F.get("leg.races", F.lit(0))
    odds = priced(F.transform("oddsNodes", lambda n: F.struct(n["combString"].alias("name"), positive(n["oddsValue"]).alias("odds"))))
    rows = p.where("oddsType in ('WIN', 'PLA')").withColumns({"race_no": race, "odds": odds}).where("race_no is not null and size(odds) > 0")
    return rows.select(
        F.concat_ws(":", F.lit("racing"), "date", "venue", "race_no", "oddsType").alias("key"), F.col("oddsType").alias("market"), F.concat_ws(":", F.lit("HK"), "date", "venue", "race_no").alias("race_id"),
        "date", "venue", "race_no", F.col("status").alias("pool_status"), F.col("sellStatus").alias("sell_status"), F.col("lastUpdateTime").alias("updated"), "odds",
    )
