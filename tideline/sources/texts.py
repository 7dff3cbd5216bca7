"""Records in text: draws in any of the shapes in which they are told, JSON that a page's script holds, notes of who cannot play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import any_date

#: By which names and paths a draw's parts go, the first that says something first; how its date may be written.
DRAW = {
    "number": ("drawNumber", "DrawNo", "id"),
    "date": ("drawDate", "date", "DrawDate"),
    "numbers": ("numbers", "Numbers", "drawNumbers", "drawResult.drawnNo"),
    "special": ("specialNumber", "SpecialNumber", "extraNumber", "drawResult.xDrawnNo"),
    "turnover": ("totalTurnover", "turnover", "TotalInvestment", "lotteryPool.totalInvestment"),
}
DRAW_DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy")

#: Headings of notes, and what stands for nobody.
SUSPENDED, DOUBTFUL, ABSENT, NOTES = "停賽", "上陣成疑", "受傷／缺陣", "軍情"
NOBODY = ("", "／", "/", "-")

SIDE = "struct<title:string,xG:string,shots:string,shotOnTarget:string,deep:string,ppda:string>"


def _first(column: str, paths: tuple[str, ...]) -> Column:
    """The first of several paths that holds more than nothing."""
    found = [F.get_json_object(column, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(~f.isin("", "0", "[]", "null", "false"), f) for f in found])


def draw_payloads(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, draw_number, draw_date, numbers, special, turnover: the draws that have a number of their own and six numbers, the six smallest.

    A draw is JSON, flat or nested; its numbers are an array or a text. A number that is none, or a broken draw, leaves it out; a
    date in no known form is null.
    """
    raw = _first(column, DRAW["numbers"])
    listed = F.from_json(raw, "array<string>")
    said = F.when(raw.startswith("["), listed).otherwise(F.filter(F.regexp_extract_all(raw, F.lit(r"(\d+)"), 1), lambda n: n.try_cast("int").between(1, 49)))
    numbers = F.array_sort(F.transform(said, lambda n: n.try_cast("int")))
    special, turnover = _first(column, DRAW["special"]), _first(column, DRAW["turnover"])
    date = F.split(_first(column, DRAW["date"]), r"\+")[0]
    out = payloads.select(
        *keep, _first(column, DRAW["number"]).alias("draw_number"), any_date(date, DRAW_DATES).alias("draw_date"), numbers.alias("numbers"),
        F.coalesce(special, F.lit("0")).try_cast("int").alias("special"), F.coalesce(turnover, F.lit("0")).try_cast("double").alias("turnover"),
    )
    sound = F.col("draw_number").isNotNull() & (F.size("numbers") >= 6) & ~F.exists("numbers", lambda n: n.isNull()) & F.col("special").isNotNull() & F.col("turnover").isNotNull()
    return out.where(sound).withColumn("numbers", F.slice("numbers", 1, 6))


def script_json(page: Column) -> Column:
    """The text that a page's script hands to JSON.parse('...'), its escapes undone; null without one."""
    held = F.regexp_extract(page, r"(?s)JSON\.parse\('(.+?)'\)", 1)
    told = F.regexp_replace(F.regexp_replace(held, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"), r"\\'", "'")
    told = F.regexp_replace(told, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')  # a text of JSON's own, whose escapes its parser undoes
    return F.when(held != "", F.get(F.from_json(F.concat(F.lit('["'), told, F.lit('"]')), "array<string>"), F.lit(0)))


def shot_records(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, date, home_team, away_team and each side's xg, shots, shots_on_target, deep, ppda, of the matches in a page's script.

    A match without a readable date, or with a figure that is no number, goes; one that is missing counts as 0.
    """
    rows = pages.select(*keep, F.explode(F.from_json(script_json(F.col(page)), f"array<struct<date:string,h:{SIDE},a:{SIDE}>>")).alias("m"))
    names = {"xG": ("xg", "double"), "shots": ("shots", "int"), "shotOnTarget": ("shots_on_target", "int"), "deep": ("deep", "int"), "ppda": ("ppda", "double")}
    figure = lambda side, c: F.when(F.coalesce(F.col(f"m.{side}.{c}"), F.lit("")) == "", F.lit(0)).otherwise(F.col(f"m.{side}.{c}").try_cast(names[c][1]))
    figures = [figure(s, c).cast(kind).alias(f"{name}_{n}") for s, name in (("h", "home"), ("a", "away")) for c, (n, kind) in names.items()]
    title = lambda s: F.coalesce(F.col(f"m.{s}.title"), F.lit(""))
    out = rows.where("m.h is not null and m.a is not null").select(*keep, F.try_to_timestamp("m.date").alias("date"), title("h").alias("home_team"), title("a").alias("away_team"), *figures)
    return out.dropna(subset=["date", *[c for c in out.columns if c.startswith(("home_", "away_")) and not c.endswith("_team")]])


def plain_text(body: Column) -> Column:
    """A page without its markup, a line each, whether it came as it is or inside JSON."""
    for a, b in ((r"\u003c", "<"), (r"\u003e", ">"), (r"\u0026", "&"), (r"\\n", "\n"), (r"\n", "\n"), (r"\"", '"')):
        body = F.replace(body, F.lit(a), F.lit(b))
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)<br */*>", "\n"), r"<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&ndash;", "-"), ("&rdquo;", '"')):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n{2,}", "\n")


def _players(text: Column) -> Column:
    names = F.transform(F.split(F.trim(text), "[、,，]"), lambda n: F.trim(n))
    return F.when(F.trim(text).isin(*NOBODY), F.array().cast("array<string>")).otherwise(F.filter(names, lambda n: ~n.isin("", "／", "/")))


def absences(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, team, suspended, doubtful, absent: the notes of a page, team by team; of several of a team the last."""
    note = rf"([^\n：:]{{1,24}})\n(?:{SUSPENDED}[：:]([^\n]*)\n)?(?:{DOUBTFUL}[：:]([^\n]*)\n)?{ABSENT}[：:]([^\n]*)"
    notes = F.regexp_extract_all(plain_text(F.col(page)), F.lit(note), 0)
    team = lambda n: F.trim(F.regexp_extract(n, note, 1))
    told = F.filter(F.transform(notes, lambda n: F.struct(team(n).alias("team"), n.alias("note"))), lambda t: (t["team"] != "") & ~t["team"].contains(NOTES))
    last = F.filter(told, lambda t, i: ~F.exists(F.slice(told, i + 2, F.greatest(F.size(told) - i - 1, F.lit(0))), lambda u: u["team"] == t["team"]))
    rows = pages.select(*keep, F.explode(last).alias("t"))
    return rows.select(*keep, "t.team", *[_players(F.regexp_extract("t.note", note, k)).alias(c) for k, c in ((2, "suspended"), (3, "doubtful"), (4, "absent"))])
