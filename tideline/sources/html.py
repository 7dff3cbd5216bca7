"""Tables of HTML pages as rows: one pass over a page's tags, then DataFrame code.

`html_rows` walks a page tag by tag and hands out a row as soon as it ends, so that a task holds a page
and one row of each table that is open, whatever the page's tables hold. `html_tables` leaves a page one row and
its tables arrays, so that what is read across a page's rows needs no shuffle. Pages need not be well formed:
a cell ends where the next one begins, a row likewise, whatever is open ends with its table or the page;
comments, scripts and styles are no text, a stray < is. What the pages say is then read by column
expressions, and by windows within a page where its rows were handed out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Rows and cells without attributes that hold text, links and plain inline elements: the same as their tags one by one, but many at once.
INLINE = r"<(?:/?(?:b|i|u|em|strong|span|small|br)|/a|a href=\"[^\"<>]+\")>"
PLAIN = re.compile(rf"<(?:(/?tr)|t([dh])>([^<]*+(?:{INLINE}[^<]*+)*+)</t[dh])>")
PLAINS = re.compile(rf"(?:\s*+<(?:t[dh]>[^<]*+(?:</t[dh]>|(?:{INLINE}[^<]*+)++</t[dh]>)|/?tr>)){{1,2000}}+")
PARTS = re.compile(INLINE)
RAW = {"script", "style"}
#: A span beyond this is taken for this, as browsers do.
SPAN = 1000
#: Cells that are handed to Spark at a time; plain cells that a task remembers, each of at most so many characters.
CELLS_AT_ONCE, KNOWN, SHORT = 100_000, 20_000, 200

CELL = pa.struct([("text", pa.string()), ("href", pa.string()), ("header", pa.bool_())])
TABLES = "tables array<struct<table:int,table_id:string,table_class:string,rows:array<struct<row:int,texts:array<string>,hrefs:array<string>,headers:array<boolean>>>>>"
ROWS = "seq int, mark string, text string, table int, table_id string, table_class string, row int, cells array<struct<text:string,href:string,header:boolean>>"


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def spanned(text: str | None) -> int:
    n = re.match(r"\s*(\d+)", text or "")
    return min(max(int(n[1]), 1), SPAN) if n else 1


def _tidy(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _plain(item: tuple[str, str, str]) -> tuple:
    """The cell that PLAIN has found."""
    content, href = item[2], None
    text = _tidy(content)
    if "<" in content:
        text = " ".join(filter(None, map(_tidy, PARTS.split(content))))
        link = re.search(r'<a href="([^"<>]+)">', content)
        href = html.unescape(link[1].strip("\"'")) if link else None
    return text, href, item[1] == "h"


class _Table:
    def __init__(self, number: int, named: dict[str, str]) -> None:
        self.number, self.named, self.row = number, named, -1
        self.cells: list | None = None  # of the open row
        self.cell: dict | None = None
        self.carry: dict[int, tuple[int, tuple]] = {}  # by column: a cell that reaches into so many more rows

    def end_cell(self) -> None:
        if self.cell is not None:
            c, self.cell = self.cell, None
            told = (" ".join(c["text"]), c["href"], c["header"])
            for _ in range(c["cols"]):
                self.fill()
                if c["rows"] > 1:
                    self.carry[len(self.cells)] = (c["rows"] - 1, told)
                self.cells.append(told)

    def fill(self) -> None:
        """Cells of rows above that reach into the next columns of this one."""
        while len(self.cells) in self.carry and self.carry[len(self.cells)][0] > 0:
            at = len(self.cells)
            left, told = self.carry[at]
            self.carry[at] = (left - 1, told)
            self.cells.append(told)

    def start_row(self) -> None:
        self.cells, self.row = [], self.row + 1

    def end_row(self) -> list | None:
        self.end_cell()
        if self.cells is None:
            return None
        self.fill()
        if self.carry:
            self.carry = {k: v for k, v in self.carry.items() if v[0] > 0}
        cells, self.cells = self.cells, None
        return cells


def walk(page: str, marks: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """(mark, text, table, table_id, table_class, row, cells) of what a page holds, in the order in which it ends.

    A row of a table has no mark. An element whose class is among marks comes with its text; so does the next
    element of the same kind, as `after <class>`.
    """
    for *said, cells in _walk(page, marks, {}):
        yield *said, None if cells is None else [dict(zip(("text", "href", "header"), c, strict=True)) for c in cells]


def _walk(page: str, marks: frozenset[str], known: dict[tuple, tuple]) -> Iterator[tuple]:
    """What walk() says, cells as (text, href, header). known: plain cells that were met before, which it adds to."""
    open_: list[_Table] = []
    marked: list[list] = []  # tag, depth, mark, texts
    awaited: dict[str, str] = {}
    tables, at = 0, 0

    def say(text: str) -> None:
        text = _tidy(text)
        if text:
            for t in open_:
                if t.cell is not None:
                    t.cell["text"].append(text)
            for m in marked:
                m[3].append(text)

    def row_of(t: _Table) -> Iterator[tuple]:
        cells = t.end_row()
        if cells:
            yield None, None, t.number, t.named.get("id"), t.named.get("class"), t.row, cells

    size = len(page)
    while at < size:
        if len(open_) == 1 and not marked and not awaited and (m := PLAINS.match(page, at)):
            t = open_[0]
            for item in PLAIN.findall(page, at, m.end()):
                if item[0]:
                    yield from row_of(t)
                    if item[0] == "tr":
                        t.start_row()
                    continue
                cell = known.get(item)
                if cell is None:
                    cell = _plain(item)
                    if len(item[2]) <= SHORT:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[item] = cell
                if t.cells is None:
                    t.start_row()
                if t.cell is not None:
                    t.end_cell()
                if t.carry:
                    t.fill()
                t.cells.append(cell)
            at = m.end()
            continue
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if not closing:
            named = attributes(m[3]) if m[3] else {}
            for x in marked:
                x[1] += x[0] == name and not m[3].endswith("/")
            mark = next((k for k in (named.get("class") or "").split() if k in marks), None) if marks else None
            if mark is not None:
                marked.append([name, 1, mark, []])
            elif name in awaited:
                marked.append([name, 1, "after " + awaited.pop(name), []])
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            elif name == "table":
                open_.append(_Table(tables, named))
                tables += 1
            elif open_ and name == "tr":
                yield from row_of(open_[-1])
                open_[-1].start_row()
            elif open_ and name in ("td", "th"):
                t = open_[-1]
                if t.cells is None:
                    t.start_row()
                t.end_cell()
                t.cell = {"text": [], "href": None, "header": name == "th", "cols": spanned(named.get("colspan")), "rows": spanned(named.get("rowspan"))}
            elif open_ and name == "a" and "href" in named:
                for t in open_:
                    if t.cell is not None and t.cell["href"] is None:
                        t.cell["href"] = named["href"]
            continue
        for x in marked:
            x[1] -= x[0] == name
        for x in [x for x in marked if x[1] == 0] if marked else ():
            marked.remove(x)
            if not x[2].startswith("after "):
                awaited[x[0]] = x[2]
            yield x[2], " ".join(x[3]), None, None, None, None, None
        if open_ and name == "table":
            yield from row_of(open_.pop())
        elif open_ and name == "tr":
            yield from row_of(open_[-1])
        elif open_ and name in ("td", "th"):
            open_[-1].end_cell()
    while open_:
        yield from row_of(open_.pop())
    for x in marked:
        yield x[2], " ".join(x[3]), None, None, None, None, None


def html_rows(pages: DataFrame, id: str, page: str = "html", marks: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all tables, and marked elements, of all pages: id, then ROWS. seq numbers them within a page.

    A cell that spans rows or columns stands in each of them. Null and empty pages have no rows.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(page).alias("page"))
    wanted = frozenset(marks)
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            kind = batch.schema.field("id").type
            out: list[tuple] = []
            for key, text in zip(batch.column("id"), batch.column("page"), strict=True):
                for seq, said in enumerate(_walk(text.as_py() or "", wanted, known)):
                    out.append((key.as_py(), seq, *said))
                    if len(out) >= 5000:
                        yield told(out, kind)
                        out = []
            yield told(out, kind)

    def told(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        *columns, cells = zip(*out, strict=True) if out else [()] * 9
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], _listed(cells)], ["id", *names])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {ROWS}").withColumnRenamed("id", id)


def _listed(rows: Sequence[list[tuple] | None]) -> pa.Array:
    """Cells of rows as arrays of CELL; flat, so that Arrow reads three columns and no cell by itself."""
    cells = [c for row in rows for c in row or ()]
    offsets = np.cumsum([0, *[len(row or ()) for row in rows]])
    none = np.array([row is None for row in rows], dtype=bool)
    columns = zip(*cells, strict=True) if cells else [()] * 3
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CELL, strict=True)], fields=list(CELL))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(none) if none.any() else None)


def _nested(found: list[list[tuple]]) -> pa.Array:
    """The tables of pages, each a list of what _walk says without marks, as an array of TABLES."""
    tables, rows, pages, starts = [], [], [0], [0]
    for said in found:
        if len({row[2] for row in said}) > 1:
            said = sorted(said, key=lambda row: row[2])  # rows of inner tables end before those around them; stable
        last = None
        for row in said:
            if row[2] != last:
                last = row[2]
                tables.append(row[2:5])
                starts.append(starts[-1])
            starts[-1] += 1
        rows += said
        pages.append(len(tables))
    table, id, kind = zip(*tables, strict=True) if tables else [()] * 3
    cells = [list(zip(*row[6], strict=True)) for row in rows]
    columns = [[row[5] for row in rows], [c[0] for c in cells], [c[1] if any(c[1]) else None for c in cells], [c[2] if any(c[2]) else None for c in cells]]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.bool_())]
    inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "texts", "hrefs", "headers"])
    outer = [pa.array(table, pa.int32()), pa.array(id, pa.string()), pa.array(kind, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), inner)]
    return pa.ListArray.from_arrays(pa.array(pages, pa.int32()), pa.StructArray.from_arrays(outer, ["table", "table_id", "table_class", "rows"]))


def html_tables(pages: DataFrame, keep: tuple[str, ...], page: str = "html") -> DataFrame:
    """keep, tables of each page; tables are those with rows, in the order in which they begin. Null and empty pages have none.

    hrefs or headers are null where no cell of a row has a link or is a heading.
    """
    rows = pages.select(*keep, F.col(page).alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            found, held, start = [], 0, 0
            kept = batch.select(list(keep))
            for stop, text in enumerate(batch.column("__page"), 1):
                found.append(list(_walk(text.as_py() or "", frozenset(), known)))
                held += sum(len(x[6]) for x in found[-1])
                if held >= CELLS_AT_ONCE or stop == len(batch):
                    yield pa.RecordBatch.from_arrays([*kept.slice(start, stop - start).columns, _nested(found)], [*keep, "tables"])
                    found, held, start = [], 0, stop

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], TABLES]))


def texts(cells: str | Column = "cells") -> Column:
    return F.transform(cells, lambda c: c["text"])


def headed(rows: DataFrame, id: str) -> DataFrame:
    """id, table, table_id, row, values: the body rows of tables with a heading, as maps from heading to text. rows: as html_rows has them.

    The heading is the rows of heading cells at a table's top; of several rows the texts of a column are
    joined by _, without blanks and repeats; a name that comes again gets its number (_2, _3).
    """
    whole = rows.where("table is not null").groupBy(id, "table").agg(F.min("table_id").alias("table_id"), F.sort_array(F.collect_list(F.struct("row", texts().alias("texts"), F.transform("cells", lambda c: c["header"]).alias("headers")))).alias("rows"))  # a table of a page
    return _by_heading(whole, id)


def headed_tables(pages: DataFrame, id: str, page: str = "html") -> DataFrame:
    """What headed() has of all tables of all pages, read page by page without a shuffle."""
    return _by_heading(html_tables(pages, (id,), page).select(id, F.inline("tables")), id)


def _by_heading(tables: DataFrame, id: str) -> DataFrame:
    """tables: id, table, table_id, rows (row, texts, headers)."""
    told = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), (r["headers"].isNotNull() & F.forall(r["headers"], lambda h: h)).alias("head"), r["texts"].alias("texts")))
    tables = tables.select(id, "table", "table_id", told.alias("rows"))
    # the body begins with the first row that is not all headings
    begins = F.array_position(F.transform("rows", lambda r: r["head"]), False).cast("int")
    tables = tables.select(id, "table", "table_id", "rows", begins.alias("begins"))
    tables = tables.select(
        id, "table", "table_id", F.when(F.col("begins") > 1, F.transform(F.slice("rows", 1, F.col("begins") - 1), lambda r: r["texts"])).alias("heads"),
        F.when(F.col("begins") > 1, F.slice("rows", F.col("begins"), F.size("rows"))).alias("body"),
    )
    width = F.array_max(F.transform("heads", lambda t: F.size(t)))
    name = lambda at: F.array_join(F.array_distinct(F.filter(F.transform("heads", lambda t: F.get(t, at)), lambda x: x != "")), "_")
    named = F.transform(F.sequence(F.lit(0), width - 1), lambda at: F.struct(name(at).alias("name"), at.alias("at")))
    tables = tables.select(id, "table", "table_id", "body", F.sort_array(F.filter(named, lambda x: x["name"] != "")).alias("named"))
    again = F.transform("named", lambda x, i: F.named_struct(F.lit("at"), x["at"], F.lit("n"), i + 2 - F.array_position("named.name", x["name"]), F.lit("name"), x["name"]))
    unlike = F.transform(again, lambda x: F.named_struct(F.lit("at"), x["at"], F.lit("name"), F.when(x["n"] > 1, F.concat_ws("_", x["name"], x["n"])).otherwise(x["name"])))
    tables = tables.select(id, "table", "table_id", "body", F.sort_array(unlike).alias("names"))
    # outer, as Spark would otherwise work out what is exploded twice, for a filter of its own
    tables = tables.select(id, "table", "table_id", "names", F.explode_outer(F.when(F.size("names") > 0, F.col("body"))).alias("r")).where("r is not null")
    values = F.transform(F.filter("names", lambda x: x["at"] < F.size("r.texts")), lambda x: F.struct(x["name"].alias("key"), F.get("r.texts", x["at"]).alias("value")))
    return tables.select(id, "table", "table_id", "r.row", F.map_from_entries(values).alias("values"))


def _cell(i: int, field: str = "text") -> Column:
    return F.get("cells", F.lit(i))[field]


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "[,$+ ]", "").try_cast("double")


def _place(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")


def _entity(text: Column, href: Column, name: Column) -> Column:
    """The id in a link, else the one in brackets behind the name, else the name itself."""
    linked = F.regexp_replace(F.regexp_extract(F.coalesce(href, F.lit("")), r"(?i)horseid=([^&]+)", 1), "HK_", "")
    named = F.regexp_extract(text, r"\(([A-Z]\d{3})\)", 1)
    return F.when(linked != "", linked).when(named != "", named).otherwise(F.replace(F.upper(name), F.lit(" "), F.lit("_")))


#: Fixed words of race pages.
GOING = "GOOD TO FIRM|GOOD TO YIELDING|WET SLOW|WET FAST|YIELDING|GOOD|SOFT|FAST|SLOW"


def metadata(text: Column) -> dict[str, Column]:
    """What a race's heading says: distance, class, surface, going."""
    kind = F.regexp_extract(text, r"(?i)\bClass\s+([A-Za-z0-9]+)", 1)
    return {
        "distance": F.coalesce(F.regexp_extract(text, r"(?i)(\d{3,4})M", 1).try_cast("int"), F.lit(0)),
        "race_class": F.when(kind != "", kind).otherwise("Open"),
        "surface": F.when(F.upper(text).contains("ALL WEATHER"), "AWT").otherwise("TURF"),
        "going": F.upper(F.regexp_extract(text, rf"(?i)\b({GOING})\b", 1)),
    }


def _venue(text: Column) -> Column:
    return F.when(F.upper(text).contains("VALLEY"), "HV").otherwise("ST")


def _slots(field: Column) -> Column:
    return F.when(field >= 7, 3).when(field >= 4, 2).otherwise(0)


def race_results(pages: DataFrame, id: str, page: str, date: str) -> DataFrame:
    """A row a runner of pages that hold one race's result.

    The race stands in the first table that names RACE n and Going, the runners in the first that names Horse No. and
    Finish Time; the place is js_racecard's text. Runners whose place is no number, races of fewer than two, and
    pages without one of the three are left out.
    """
    whole = lambda t: F.array_join(F.flatten(F.transform(t["rows"], lambda r: r["texts"])), " ")
    told = F.transform("tables", lambda t: F.struct(t["table_class"].alias("kind"), whole(t).alias("whole"), t["rows"].alias("rows")))
    read = html_tables(pages.select(id, page, F.col(date).cast("date").alias("date")), (id, "date"), page).select(id, "date", told.alias("told"))
    first = lambda rule: F.get(F.filter("told", rule), F.lit(0))
    read = read.select(
        id, "date", F.split(first(lambda t: F.array_contains(F.split(t["kind"], " "), "js_racecard"))["whole"], ":")[0].alias("venue"),
        first(lambda t: t["whole"].rlike(r"RACE\s+\d+") & t["whole"].contains("Going"))["whole"].alias("race"),
        first(lambda t: t["whole"].contains("Horse No.") & t["whole"].contains("Finish Time"))["rows"].alias("rows"),
    )
    body = lambda r, c: F.when(r["headers"].isNull(), r[c]).otherwise(F.filter(r[c], lambda _, i: ~F.get(r["headers"], i)))
    bodies = F.transform(F.filter("rows", lambda r: r["row"] > 0), lambda r: F.named_struct(F.lit("texts"), body(r, "texts"), F.lit("hrefs"), body(r, "hrefs")))
    runners = F.filter(bodies, lambda r: (F.size(r["texts"]) >= 12) & _place(F.get(r["texts"], F.lit(0))).isNotNull())
    read = read.select(id, "date", "venue", "race", F.when((F.col("venue") != "") & F.col("race").isNotNull(), runners).alias("runners"))
    number = F.regexp_extract("race", r"RACE\s+(\d+)", 1).cast("int")
    named = F.trim(F.regexp_extract("race", rf"(?is)Going\s*:\s*(?:{GOING})\s+(.*?)\s+Course\s*:", 1))
    # what is said of the race is read once, before it has a row a runner
    races = read.select(
        id, F.concat_ws(":", F.lit("HK"), "date", _venue(F.col("venue")), number).alias("race_id"), "date", "venue", number.alias("race_number"), named.alias("race_name"),
        *[c.alias(k) for k, c in metadata(F.col("race")).items()], F.size("runners").cast("long").alias("field_size"), F.when(F.size("runners") >= 2, F.col("runners")).alias("runners"),
    )
    rows = races.select(*[c for c in races.columns if c != "runners"], F.inline_outer("runners")).where("texts is not null")  # outer, as Spark would otherwise work out what is exploded twice, for a filter of its own
    text = lambda i: F.get("texts", F.lit(i))
    rows = rows.withColumns({"finish_position": _place(text(0)), "horse_name": F.trim(F.regexp_replace(text(2), r"\s*\([A-Z]\d{3}\)\s*$", ""))})
    return rows.select(
        id, "race_id", "date", "venue", "race_number", "race_name", "distance", "race_class", "surface", "going", _entity(text(2), F.get("hrefs", F.lit(2)), F.col("horse_name")).alias("horse_id"), "horse_name", text(3).alias("jockey"), text(4).alias("trainer"),
        _number(text(5)).alias("weight"), _number(text(6)).alias("horse_weight"), _number(text(7)).alias("draw"), "finish_position", "field_size",
        (F.col("finish_position") == 1).cast("int").alias("won"), (F.col("finish_position") <= _slots(F.col("field_size"))).cast("int").alias("placed"), text(10).alias("finish_time"), _number(text(11)).alias("win_odds"),
    )


def day_results(pages: DataFrame, id: str, page: str, date: str) -> DataFrame:
    """A row a runner of pages that hold all races of a day: each race a heading (bg_blue), what follows it, and a result table."""
    rows = html_rows(pages, id, page, ("bg_blue",))
    before = Window.partitionBy(id).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = lambda mark: F.last(F.when(F.col("mark") == mark, F.col("text")), ignorenulls=True).over(before)
    venue = F.min(F.when(F.array_contains(F.split("table_class", " "), "js_racecard"), F.struct("seq", _cell(0).alias("v")))).over(Window.partitionBy(id))["v"]
    rows = rows.select("*", said("bg_blue").alias("label"), F.coalesce(said("after bg_blue"), F.lit("")).alias("about"), F.split(venue, ":")[0].alias("venue"))
    rows = rows.where(F.array_contains(F.split("table_class", " "), "result") & (F.col("row") > 0) & (F.col("venue") != ""))
    number = F.regexp_extract("label", r"(\d+)", 1).try_cast("int")
    rows = rows.withColumns({"race_number": number, "cells": F.filter("cells", lambda c: ~c["header"])}).where("race_number is not null and size(cells) >= 7")
    rows = rows.withColumn("finish_position", _place(_cell(0))).where("finish_position is not null")
    rows = rows.withColumn("field_size", F.count(F.lit(1)).over(Window.partitionBy(id, "table"))).where("field_size >= 2").join(pages.select(id, F.col(date).cast("date").alias("date")), id)
    name = F.trim(F.regexp_replace(_cell(2), r"\s*\([A-Z]\d{3}\)\s*$", ""))
    return rows.select(
        id, F.concat_ws(":", F.lit("HK"), "date", _venue(F.col("venue")), "race_number").alias("race_id"), "date", "venue", "race_number", *[c.alias(k) for k, c in metadata(F.col("about")).items()],
        _entity(_cell(2), _cell(2, "href"), name).alias("horse_id"), name.alias("horse_name"), _cell(3).alias("jockey"), _cell(4).alias("trainer"), _number(_cell(5)).alias("weight"), _number(_cell(6)).alias("draw"),
        "finish_position", "field_size", (F.col("finish_position") == 1).cast("int").alias("won"), (F.col("finish_position") <= _slots(F.col("field_size"))).cast("int").alias("placed"),
    )


def race_cards(pages: DataFrame, id: str, page: str) -> DataFrame:
    """A race a page: race_id, start_time (text with its zone), race_name, metadata, and its declared runners as an array.

    The heading is the first f_fs13 element that begins with Race, the runners are the table starter; pages without
    them, without date, place or time, or of fewer than two runners, are left out.
    """
    rows = html_rows(pages, id, page, ("f_fs13",))
    heading = F.min(F.when(F.col("mark").isNotNull() & F.col("text").startswith("Race "), F.struct("seq", "text"))).over(Window.partitionBy(id))["text"]
    starter = F.min(F.when(F.array_contains(F.split("table_class", " "), "starter"), F.col("table"))).over(Window.partitionBy(id))
    rows = rows.withColumns({"heading": heading, "starter": starter}).where("table = starter and row > 0 and heading is not null")
    rows = rows.withColumn("cells", F.filter("cells", lambda c: ~c["header"])).where((F.size("cells") >= 27) & (_cell(3) != ""))
    runner = F.struct(
        F.col("row"), _entity(_cell(3), _cell(3, "href"), _cell(3)).alias("horse_id"), _cell(3).alias("horse_name"), F.coalesce(_number(_cell(0)).cast("int"), F.lit(0)).alias("number"), _cell(1).alias("last_six"), _number(_cell(5)).alias("weight"),
        _cell(6).alias("jockey"), _number(_cell(8)).alias("draw"), _cell(9).alias("trainer"), _number(_cell(11)).alias("rating"), _number(_cell(12)).alias("rating_change"), _number(_cell(13)).alias("horse_weight"),
        _number(_cell(16)).alias("age"), _number(_cell(21)).alias("days_since_last_run"), _cell(22).alias("gear"),
    )
    races = rows.groupBy(id, "heading").agg(F.sort_array(F.collect_list(runner)).alias("runners")).where("size(runners) >= 2")  # a race's runners
    h = F.col("heading")
    days, months = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday", "January|February|March|April|May|June|July|August|September|October|November|December"
    number = F.regexp_extract(h, r"^Race\s+(\d+)", 1).try_cast("int")
    name = F.trim(F.regexp_extract(h, rf"Race\s+\d+\s*-\s*(.*?)\s+(?:{days}),", 1))
    date = F.try_to_date(F.regexp_extract(h, rf"((?:{months})\s+\d{{1,2}},\s+\d{{4}})", 1), "MMMM d, yyyy")
    place = F.regexp_extract(h, r",\s*(Sha Tin|Happy Valley),\s*\d{1,2}:\d{2}", 1)
    time = F.regexp_extract(h, r"(?:Sha Tin|Happy Valley),\s*(\d{1,2}:\d{2})", 1)
    races = races.select(id, number.alias("race_number"), name.alias("race_name"), date.alias("date"), place.alias("venue"), time.alias("time"), *[c.alias(k) for k, c in metadata(h).items()], "runners")
    races = races.where("race_number is not null and date is not null and venue <> '' and time <> ''")
    return races.select(
        id, F.concat_ws(":", F.lit("HK"), "date", _venue(F.col("venue")), "race_number").alias("race_id"), "date", F.concat(F.col("date").cast("string"), F.lit("T"), F.lpad("time", 5, "0"), F.lit(":00+08:00")).alias("start_time"),
        "venue", "race_number", "race_name", "distance", "race_class", "surface", "going", F.transform("runners", lambda r: r.dropFields("row")).alias("runners"),
    )


def trial_results(pages: DataFrame, id: str, page: str) -> DataFrame:
    """A row a runner of trial pages; date (heading), place, distance and going are carried down from the rows above."""
    rows = html_rows(pages, id, page, ("bg_blue",))
    before = Window.partitionBy(id).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(id, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    label = F.last(F.when(F.col("mark") == "bg_blue", F.col("text")), ignorenulls=True).over(before)
    wanted = F.arrays_overlap(F.split(F.coalesce("table_class", F.lit("")), " "), F.array(*map(F.lit, ("bd_tdb_font", "js_racecard", "result"))))
    rows = rows.withColumn("label", label).where(wanted).withColumn("cells", F.filter("cells", lambda c: ~c["header"])).withColumn("line", F.array_join(texts(), " "))
    found = lambda rule: F.when(F.regexp_extract("line", rule, 1) != "", F.regexp_extract("line", rule, 1))
    down = lambda c: F.last(c, ignorenulls=True).over(inside)
    place = F.upper(found("(?i)(Sha Tin|Happy Valley|Conghua)"))
    rows = rows.withColumns({
        "date": F.coalesce(F.try_to_date(F.regexp_extract("label", r"(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy"), F.try_to_date(F.regexp_extract("label", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")),
        "venue": F.coalesce(down(F.when(place == "SHA TIN", "ST").when(place == "HAPPY VALLEY", "HV").when(place == "CONGHUA", "CH")), F.lit("")),
        "distance": F.coalesce(down(found(r"(?i)(\d{3,4})M").cast("int")), F.lit(0)),
        "going": F.coalesce(down(F.upper(found(r"(?i)\b(GOOD|YIELDING|SOFT|FAST|SLOW|WET)\b"))), F.lit("")),
        "position": _place(_cell(0)),
    }).where("date is not null and size(cells) >= 4 and position is not null")
    minutes = [F.regexp_extract(_cell(3), r"(\d{1,2})[.:](\d{2})[.:](\d{2})", k).try_cast("double") for k in (1, 2, 3)]
    seconds = F.regexp_extract(_cell(3), r"(\d+\.?\d*)", 1).try_cast("double")
    linked = F.regexp_replace(F.regexp_extract(F.coalesce(_cell(1, "href"), F.lit("")), r"(?i)horseid=([^&]+)", 1), "HK_", "")
    return rows.select(
        id, F.when(linked != "", linked).otherwise(F.replace(F.upper(_cell(1)), F.lit(" "), F.lit("_"))).alias("horse_id"), _cell(1).alias("horse_name"), "date", "venue", "distance", "going", "position",
        F.coalesce(minutes[0] * 60 + minutes[1] + minutes[2] / 100, F.when(seconds < 300, seconds)).alias("seconds"),
    )
