"""Race meetings and their pools, and match results, from nested JSON, without leaving the JVM.

What a payload holds is read by its schema; runners and quotes stay arrays and maps of their race and are
worked on by higher-order functions, so that a race stays one row from its card to its priced pools.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = "data struct<activeMeetings:array<struct<date:string, venueCode:string, status:string>>>"
CARDS = """data struct<raceMeetings:array<struct<date:string, venueCode:string, status:string, races:array<struct<no:int, status:string, postTime:string, distance:int, go_en:string, claCode:string, raceClass_ch:string, raceClass_en:string,
raceTrack:struct<description_en:string>, runners:array<struct<no:string, name_ch:string, name_en:string, status:string, barrierDrawNumber:string, handicapWeight:string, currentRating:string, last6run:string, gearInfo:string, winOdds:string, finalPosition:int,
horse:struct<code:string>, jockey:struct<name_ch:string>, trainer:struct<name_ch:string>>>>>>>>"""
POOLS = "data struct<raceMeetings:array<struct<pmPools:array<struct<oddsType:string, sellStatus:string, oddsNodes:array<struct<combString:string, oddsValue:string>>>>>>>"
RESULTS = "data struct<matches:array<struct<id:string, kickOffTime:string, status:string, results:array<struct<resultType:int, stageId:int, homeResult:int, awayResult:int>>>>>"

#: What a result must be of to hold final corner counts.
RESULT_TYPE, FINAL_STAGE = 2, 5


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _numbered(no: Column) -> Column:
    """A number as two digits; longer ones stay whole."""
    return F.when(F.length(no) < 2, F.lpad(no, 2, "0")).otherwise(no)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value worked out once a row; named in a lambda, an expression is worked out for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _mapped(entries: Column) -> Column:
    """Entries (key, value) as a map; of entries with one key the last counts."""

    def last(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda f: f["key"] == e["key"]))

    return _once(entries, lambda m: F.map_from_entries(last(m)))


def active_meetings(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, date, venue, status, selected: the meetings of each payload that have a date and place; selected is the newest that is not closed, or the newest."""
    m = F.from_json(column, ACTIVE)["data"]["activeMeetings"]
    named = F.filter(m, lambda x: (_text(x["date"]) != "") & (_text(x["venueCode"]) != ""))
    told = F.transform(named, lambda x, i: F.struct((F.upper(_text(x["status"])) != "CLOSED").alias("open"), x["date"].alias("date"), (-i).alias("place"), x["venueCode"].alias("venue"), _text(x["status"]).alias("status")))
    rows = payloads.select(*keep, told.alias("m")).select(*keep, F.array_max("m").alias("best"), F.inline("m"))
    same = (F.col("place") == F.col("best.place")) & (F.col("date") == F.col("best.date"))
    return rows.select(*keep, "date", "venue", "status", same.alias("selected"))


def race_cards(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, and a row a numbered race of a payload's first meeting: race_id, date, venue, race_number, status, post_time, distance, going, surface, race_class, runners, win_odds.

    A runner's key is its horse's code, else its number as two digits. Scratched and withdrawn runners, and prices of 1 or less,
    are never in win_odds.
    """
    m = F.get(F.from_json(column, CARDS)["data"]["raceMeetings"], F.lit(0))
    races = payloads.select(*keep, m.alias("m")).select(*keep, F.col("m.date").alias("date"), F.col("m.venueCode").alias("venue"), F.explode_outer("m.races").alias("r")).where("r.no is not null")  # outer, as Spark would otherwise read the payload again for a filter of its own

    def runner(x: Column) -> Column:
        number, status = _text(x["no"]), _text(x["status"])
        code = _text(x["horse"]["code"])
        return F.struct(
            number.alias("number"), F.when(code == "", _numbered(number)).otherwise(code).alias("key"), _text(x["name_ch"]).alias("name"), _text(x["name_en"]).alias("name_english"), status.alias("status"), F.lower(status).rlike("scratch|withdraw").alias("scratched"),
            x["barrierDrawNumber"].try_cast("int").alias("draw"), x["handicapWeight"].try_cast("double").alias("weight"), x["currentRating"].try_cast("double").alias("rating"), _text(x["last6run"]).alias("last_six"), _text(x["jockey"]["name_ch"]).alias("jockey"),
            _text(x["trainer"]["name_ch"]).alias("trainer"), _text(x["gearInfo"]).alias("gear"), x["winOdds"].try_cast("double").alias("odds"), x["finalPosition"].alias("position"),
        )

    r = F.col("r")
    races = races.withColumn("runners", F.transform(F.coalesce("r.runners", F.array().cast("array<struct<no:string, name_ch:string, name_en:string, status:string, barrierDrawNumber:string, handicapWeight:string, currentRating:string, last6run:string, gearInfo:string, winOdds:string, finalPosition:int, horse:struct<code:string>, jockey:struct<name_ch:string>, trainer:struct<name_ch:string>>>")), runner))
    priced = F.transform(F.filter("runners", lambda x: ~x["scratched"] & (x["odds"] > 1)), lambda x: F.struct(x["key"].alias("key"), x["odds"].alias("value")))
    return races.withColumn("__priced", priced).select(
        *keep, F.concat_ws(":", F.lit("HK"), "date", "venue", r["no"]).alias("race_id"), "date", "venue", r["no"].alias("race_number"), _text(r["status"]).alias("status"), F.try_to_timestamp(r["postTime"]).alias("post_time"), F.coalesce(r["distance"], F.lit(0)).alias("distance"),
        _text(r["go_en"]).alias("going"), F.when(F.upper(_text(r["raceTrack"]["description_en"])).contains("ALL WEATHER"), "AWT").otherwise("TURF").alias("surface"), F.coalesce(r["claCode"], r["raceClass_ch"], r["raceClass_en"], F.lit("")).alias("race_class"),
        "runners", _mapped(F.col("__priced")).alias("win_odds"),
    )


def with_pools(races: DataFrame, payloads: DataFrame, race: str = "race_id", column: str = "payload") -> DataFrame:
    """races (race_cards()) with win_odds, place_odds and pool_closed as the pools of each race's payload have them.

    payloads: race, payload; one a race. Quotes are renamed from numbers to the runners' keys; those of scratched
    runners, and prices of 1 or less, go. Of several pools of a kind the last with a quote counts; without one a race keeps what
    it had. A pool is closed unless its win pool is said to sell.
    """
    return pooled(races.join(payloads.select(race, F.col(column).alias("__payload")), race, "left"), "__payload").drop("__payload")


def pooled(races: DataFrame, column: str) -> DataFrame:
    """with_pools() of races that have the payload of their pools in a column, which stays."""
    pools = F.coalesce(F.get(F.from_json(column, POOLS)["data"]["raceMeetings"], F.lit(0))["pmPools"], F.array().cast("array<struct<oddsType:string, sellStatus:string, oddsNodes:array<struct<combString:string, oddsValue:string>>>>"))
    both = races.withColumn("__pools", pools)
    keys = _mapped(F.transform("runners", lambda x: F.struct(_numbered(x["number"]).alias("key"), x["key"].alias("value"))))
    gone = F.transform(F.filter("runners", lambda x: x["scratched"]), lambda x: _numbered(x["number"]))
    node = lambda n: F.struct(_numbered(_text(n["combString"])).alias("number"), n["oddsValue"].try_cast("double").alias("odds"))
    nodes = lambda p, k: F.filter(F.transform(F.coalesce(p["oddsNodes"], F.array().cast("array<struct<combString:string, oddsValue:string>>")), node), lambda q: (q["odds"] > 1) & ~F.array_contains(k["gone"], q["number"]))
    quotes = lambda p, k: F.transform(nodes(p, k), lambda q: F.struct(F.coalesce(F.try_element_at(k["keys"], q["number"]), q["number"]).alias("key"), q["odds"].alias("value")))
    told = lambda k: F.transform("__pools", lambda p: F.struct(_text(p["oddsType"]).alias("kind"), (F.upper(_text(p["sellStatus"])) != "AVAILABLE").alias("closed"), quotes(p, k).alias("quotes")))
    both = both.withColumn("__told", F.filter(_once(F.struct(keys.alias("keys"), gone.alias("gone")), told), lambda p: F.size(p["quotes"]) > 0))
    last = lambda kind: F.try_element_at(F.filter("__told", lambda p: p["kind"] == kind), F.lit(-1))
    both = both.withColumns({"__win": last("WIN"), "__place": last("PLA")})
    held = [c for c in races.columns if c != "win_odds"]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return both.select(
        *held, F.when(F.col("__win").isNotNull(), _mapped(F.col("__win.quotes"))).otherwise(F.col("win_odds")).alias("win_odds"),
        F.when(F.col("__place").isNotNull(), _mapped(F.col("__place.quotes"))).otherwise(empty).alias("place_odds"), F.coalesce("__win.closed", F.lit(False)).alias("pool_closed"),
    )


def corner_results(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, match_id, kick_off, home, away, status: the final counts of the matches that have them; of several results the last."""
    matches = payloads.select(*keep, F.explode(F.from_json(column, RESULTS)["data"]["matches"]).alias("m"))
    final = F.filter("m.results", lambda r: (r["resultType"] == RESULT_TYPE) & (r["stageId"] == FINAL_STAGE))
    rows = matches.select(*keep, F.col("m.id").alias("match_id"), F.try_to_timestamp("m.kickOffTime").alias("kick_off"), F.try_element_at(final, F.lit(-1)).alias("r"), _text(F.col("m.status")).alias("status"))
    rows = rows.where((_text(F.col("match_id")) != "") & F.col("kick_off").isNotNull() & F.col("r.homeResult").isNotNull() & F.col("r.awayResult").isNotNull())
    return rows.select(*keep, "match_id", "kick_off", F.col("r.homeResult").alias("home"), F.col("r.awayResult").alias("away"), "status")
