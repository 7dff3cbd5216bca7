"""Rows of match files, which are all text, as typed matches and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import any_date

#: The columns that count or price, where a file has them; what matches and fixtures need.
COUNTS = ("FTHG", "FTAG", "HS", "AS", "HST", "AST", "HC", "AC")
PRICES = ("AvgH", "AvgD", "AvgA", "B365H", "B365D", "B365A", "Avg>2.5", "Avg<2.5", "B365>2.5", "B365<2.5")
MATCH, FIXTURE = ("Div", "Date", "HomeTeam", "AwayTeam", "HC", "AC"), ("Div", "Date", "HomeTeam", "AwayTeam")

#: Day first, as these files write dates.
DATES = ("dd/MM/yyyy", "yyyy-MM-dd")


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def day_first(text: Column) -> Column:
    """A date written day first; years of two digits lie in 1969 to 2068."""
    head, tail = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 1), F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    whole = F.concat(head, F.when(tail.cast("int") >= 69, "19").otherwise("20"), tail)
    return any_date(F.when(head != "", whole).otherwise(text), DATES)


def _typed(rows: DataFrame, numbers: tuple[str, ...], needed: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumns({"Date": day_first(F.col("Date"))} | {c: _name(c).try_cast("double") for c in numbers if c in rows.columns})
    present = F.lit(True)
    for c in needed:
        present = present & _name(c).isNotNull()
    return rows.where(present)


def normalised_matches(rows: DataFrame, season: str, divisions: list[str]) -> DataFrame | None:
    """The matches of some divisions, with Season and Division; HC and AC whole. None where a needed column is missing.

    A date, team or corner count that is missing or unreadable leaves its row out; other numbers become null.
    """
    if not set(MATCH) <= set(rows.columns):
        return None
    out = _typed(rows.where(F.col("Div").isin(divisions)), COUNTS + PRICES, MATCH)
    return out.withColumns({"Season": F.lit(season), "Division": F.col("Div"), "HC": F.col("HC").cast("int"), "AC": F.col("AC").cast("int")})


def seasons(files: DataFrame, wanted: list[str], others: list[str] = ()) -> DataFrame:
    """The matches of season_files(), each under the season of its file, of the divisions wanted and others.

    A row of another division than its file's goes. ValueError where a wanted division has no match, or a needed column
    is in no file.
    """
    missing = [c for c in MATCH if c not in files.columns]
    if missing:
        raise ValueError(f"no file has {', '.join(missing)}")
    rows = files.where((F.col("Div") == F.col("__division")) & F.col("Div").isin([*wanted, *others]))
    out = _typed(rows, COUNTS + PRICES, MATCH).withColumns({"Season": F.col("__season"), "Division": F.col("Div"), "HC": F.col("HC").cast("int"), "AC": F.col("AC").cast("int")}).drop("__season", "__division")
    found = {r.Div for r in out.select("Div").distinct().collect()}  # as many as divisions
    if empty := [d for d in wanted if d not in found]:
        raise ValueError(f"no match of {', '.join(empty)}")
    return out


def normalised_fixtures(rows: DataFrame, divisions: list[str]) -> DataFrame | None:
    """The fixtures of some divisions by date. None where a needed column is missing."""
    if not set(FIXTURE) <= set(rows.columns):
        return None
    return _typed(rows.where(F.col("Div").isin(divisions)), PRICES, FIXTURE).orderBy("Date")


def feature_columns(columns: list[str], meta: set[str]) -> list[str]:
    """All columns but those that say what a row is."""
    return [c for c in columns if c not in meta]


def renamed_by_part(rows: DataFrame, parts: dict[str, str]) -> DataFrame:
    """rows with each column named after the first part that its lower-cased name contains; other columns, and later ones of a name, go."""
    taken: dict[str, str] = {}
    for c in rows.columns:
        new = next((n for part, n in parts.items() if part in c.lower()), None)
        if new and new not in taken.values():
            taken[c] = new
    return rows.select(*[_name(c).alias(n) for c, n in taken.items()])
