"""HTML tables: against the standard library's parser, on malformed pages, and race pages by hand."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tideline.sources import html as H

RESULT = """
<table class="js_racecard"><tr><td>Sha Tin:</td></tr></table>
<table><tr><td>RACE 1 (1)</td></tr><tr><td>Class 4 - 1200M - (60-40)</td><td>Going :</td><td>GOOD</td></tr>
<tr><td>TEST HANDICAP</td><td>Course :</td><td>TURF - "A" Course</td></tr></table>
<table class="table_bd draggable"><tr><td>Pla.</td><td>Horse No.</td><td>Horse</td><td>Jockey</td><td>Trainer</td><td>Act. Wt.</td><td>Declar. Horse Wt.</td>
<td>Dr.</td><td>LBW</td><td>Running Position</td><td>Finish Time</td><td>Win Odds</td></tr>
<tr><td>1</td><td>2</td><td><a href="?HorseId=HK_2024_K001">ALPHA (K001)</a></td><td>J One</td><td>T One</td><td>128</td><td>1100</td><td>3</td><td>---</td><td>2 1</td><td>1:09.10</td><td>4.5</td></tr>
<tr><td>2</td><td>1</td><td>BETA (J002)</td><td>J Two</td><td>T Two</td><td>130</td><td>1,088</td><td>1</td><td>1</td><td>1 2</td><td>1:09.20</td><td>---</td></tr>
<tr><td>WV</td><td>3</td><td>GAMMA BOY</td><td>J</td><td>T</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>
"""

CARD = """<div class="f_fs13">Notice</div><div class="f_fs13">Race 1 - TEST HANDICAP Wednesday, July 15, 2026, Happy Valley, 18:30 Turf, "C" Course, 1650M, Good Prize Money: $875,000, Rating: 40-0, Class 5</div>
<table class="starter"><tr>{head}</tr><tr><td>1</td><td>2/3/4</td><td></td><td><a href="?horseid=HK_2024_K001">ALPHA</a></td><td>K001</td><td>128</td><td>J One</td><td></td><td>3</td><td>T One</td>
<td>-</td><td>40</td><td>-2</td><td>1100</td><td>+2</td><td></td><td>4</td><td>-</td><td>g</td><td>0</td><td></td><td>14</td><td>TT</td><td>Owner</td><td>Sire</td><td>Dam</td><td>PPG</td></tr>
<tr><td>2</td><td>5/6</td><td></td><td>BETA STAR</td><td>J002</td><td>125</td><td>J Two</td><td></td><td>1</td><td>T Two</td>
<td>-</td><td>37</td><td>0</td><td>1080</td><td>-1</td><td></td><td>5</td><td>-</td><td>g</td><td>0</td><td></td><td>21</td><td></td><td>Owner</td><td>Sire</td><td>Dam</td><td>PP</td></tr></table>""".replace("{head}", "<th>x</th>" * 27)

DAY = """<table class="js_racecard"><tr><td>Happy Valley: all</td></tr></table><div class="race_result">
<div class="f_fs13 margin_top15"><div class="bg_blue">Race 1</div><div>Class 3 - 1650M GOOD TO YIELDING, All Weather Track</div><table class="result"><tr><th>h</th></tr>
<tr><td>1</td><td>4</td><td>ONE (A001)</td><td>J</td><td>T</td><td>120</td><td>5</td></tr><tr><td>2 DH</td><td>5</td><td>TWO (A002)</td><td>J</td><td>T</td><td>121</td><td>6</td></tr></table></div>
<div class="f_fs13 margin_top15"><div class="bg_blue">Race 2</div><div>1000M</div><table class="result"><tr><th>h</th></tr><tr><td>1</td><td>4</td><td>ALONE</td><td>J</td><td>T</td><td>120</td><td>5</td></tr></table></div></div>"""

TRIAL = """<div class="bg_blue">Trials 03/07/2026</div><table class="bd_tdb_font"><tr><td>Sha Tin 1200M Good</td></tr><tr><td>1</td><td><a href="x?horseid=HK_2024_K001&y=1">ALPHA</a></td><td>J</td><td>1.09.50</td></tr>
<tr><td>2</td><td>BETA STAR</td><td>J</td><td>71.2</td></tr><tr><td>Conghua 1000M</td></tr><tr><td>1</td><td>GAMMA</td><td>J</td><td>none</td></tr><tr><td>x</td><td>D</td><td>J</td><td>1</td></tr></table>
<table class="other"><tr><td>1</td><td>D</td><td>J</td><td>1</td></tr></table>"""


class Oracle(HTMLParser):
    """Cells of well-formed tables, in the order in which rows end."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.rows = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.tables, None, None])
            self.tables += 1
        elif tag == "tr":
            self.open[-1][1] = []
        elif tag in ("td", "th"):
            self.open[-1][2] = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open[-1][1].append(" ".join(self.open[-1][2]))
            self.open[-1][2] = None
        elif tag == "tr":
            self.rows.append((self.open[-1][0], self.open[-1][1]))
            self.open[-1][1] = None
        elif tag == "table":
            self.open.pop()

    def handle_data(self, data):
        text = " ".join(data.split())
        for t in self.open:
            if t[2] is not None and text:
                t[2].append(text)


def table(r, depth=0):
    def cell():
        inner = "".join(r.choice(["a &amp; b", "<b>bold</b>", "x<br>y", " \n ", "<!-- <td>no</td> -->", "1 &lt; 2", "é"]) for _ in range(r.randrange(4)))
        return f"<td>{inner}{table(r, depth + 1) if depth < 2 and r.random() < 0.15 else ''}</td>"

    return f"<table border='1' id=\"t>{depth}\">" + "".join("<tr class=x>" + "".join(cell() for _ in range(r.randrange(1, 4))) + "</tr>" for _ in range(r.randrange(1, 4))) + "</table>"


def test_rows_like_the_standard_parser():
    r = random.Random(2)
    for _ in range(150):
        page = "<html><body><p>before" + "".join(table(r) + "between" for _ in range(r.randrange(3))) + "</body>"
        oracle = Oracle()
        oracle.feed(page)
        assert [(x[2], [c["text"] for c in x[6]]) for x in H.walk(page)] == oracle.rows


def cells(page):
    return [[c["text"] for c in x[6]] for x in H.walk(page)]


def test_malformed_pages():
    assert cells("<table><tr><td>1<td>2<tr><td>3") == [["1", "2"], ["3"]]
    assert cells("<table><td>1</td><td>2</table>") == [["1", "2"]]
    assert cells("<TABLE><TR><TH>A</th></TR>") == [["A"]]
    assert cells("a < b <table><tr><td>1 < 2 & 3</td></tr></table>") == [["1 < 2 & 3"]]
    assert cells("<table><tr><td><script>if (a < '</td>') x</script>s<style>td {}</style></td></tr></table>") == [["s"]]
    assert cells("<table><tr><td>open <!-- never closed </td></tr>") == [["open"]]
    assert cells("</td></tr></table><tr><td>no table</td></tr>") == [] and cells("") == [] and cells("<") == [] and cells("<table></table><table><tr></tr></table>") == []


def test_spans_stand_in_each_place():
    page = "<table><tr><td rowspan=2>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td rowspan=99>d</td></tr><tr><td>e</td><td>f</td></tr><tr><td colspan=x>g</td></tr></table>"
    assert cells(page) == [["a", "b", "b"], ["a", "c", "d"], ["e", "f", "d"], ["g"]]
    assert cells("<table><tr><td rowspan=3 colspan=2>x</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr><tr><td>4</td></tr></table>") == [["x", "x", "1"], ["x", "x", "2"], ["x", "x", "3"], ["4"]]


def test_marks_and_what_follows_them():
    out = list(H.walk('<div class="a k"> one <div>in</div></div> <p>p</p><div>next</div><div>far</div><div class=k>open', frozenset({"k"})))
    assert [(x[0], x[1]) for x in out] == [("k", "one in"), ("after k", "next"), ("k", "open")]


def frame(spark, *pages):
    return spark.createDataFrame([(i, p, "2026-07-01") for i, p in enumerate(pages)], "page_id long, html string, day string")


def test_headed_tables(spark):
    page = "<table id=stats><tr><th></th><th colspan=2>Goals</th><th>Age</th></tr><tr><th>Squad</th><th>For</th><th>For</th><th>Age</th></tr><tr><th>Alpha</th><td>3</td><td>4</td><td>25</td></tr><tr><td>Beta</td><td>1</td></tr></table>"
    rows = H.headed(H.html_rows(frame(spark, page, None, "", "<table><tr><td>no heading</td></tr></table>"), "page_id"), "page_id").orderBy("row").collect()
    assert [(r.page_id, r.table_id, r["values"]) for r in rows] == [(0, "stats", {"Squad": "Alpha", "Goals_For": "3", "Goals_For_2": "4", "Age": "25"}), (0, "stats", {"Squad": "Beta", "Goals_For": "1"})]


def test_race_results(spark):
    rows = H.race_results(frame(spark, RESULT, None, "<table><tr><td>x</td></tr></table>", RESULT.replace("Sha Tin", "")), "page_id", "html", "day").orderBy("finish_position").collect()
    assert len(rows) == 2
    a, b = rows
    assert (a.race_id, a.horse_id, a.horse_name, a.field_size, a.won, a.placed, a.race_name, a.distance, a.race_class, a.going, a.finish_time, a.win_odds, a.draw) == ("HK:2026-07-01:ST:1", "2024_K001", "ALPHA", 2, 1, 0, "TEST HANDICAP", 1200, "4", "GOOD", "1:09.10", 4.5, 3.0)
    assert (b.horse_id, b.horse_weight, b.win_odds, b.won) == ("J002", 1088.0, None, 0)


def test_race_cards(spark):
    race = H.race_cards(frame(spark, CARD, CARD.replace("18:30", ""), CARD.replace("starter", "other"), None), "page_id", "html").collect()
    assert len(race) == 1
    race = race[0]
    assert (race.race_id, race.start_time, race.race_name, race.distance, race.going, race.race_class) == ("HK:2026-07-15:HV:1", "2026-07-15T18:30:00+08:00", "TEST HANDICAP", 1650, "GOOD", "5")
    assert [(r.number, r.horse_id, r.horse_name, r.rating_change, r.days_since_last_run, r.gear) for r in race.runners] == [(1, "2024_K001", "ALPHA", -2.0, 14.0, "TT"), (2, "BETA_STAR", "BETA STAR", 0.0, 21.0, "")]


def test_day_results_and_trials(spark):
    rows = H.day_results(frame(spark, DAY), "page_id", "html", "day").orderBy("finish_position").collect()
    assert [(r.race_id, r.horse_id, r.finish_position, r.distance, r.surface, r.going, r.race_class) for r in rows] == [("HK:2026-07-01:HV:1", "A001", 1, 1650, "AWT", "GOOD TO YIELDING", "3"), ("HK:2026-07-01:HV:1", "A002", 2, 1650, "AWT", "GOOD TO YIELDING", "3")]
    rows = H.trial_results(frame(spark, TRIAL), "page_id", "html").collect()
    assert sorted((r.horse_id, str(r.date), r.venue, r.distance, r.going, r.position, r.seconds) for r in rows) == [("2024_K001", "2026-07-03", "ST", 1200, "GOOD", 1, 69.5), ("BETA_STAR", "2026-07-03", "ST", 1200, "GOOD", 2, 71.2), ("GAMMA", "2026-07-03", "CH", 1000, "GOOD", 1, None)]


def test_a_long_page_is_read_whole(spark):
    page = "<table>" + "".join(f"<tr><td>{i}</td><td>{i % 7}</td></tr>" for i in range(30_000)) + "</table>"
    out = H.html_rows(frame(spark, page), "page_id").agg(F.count("*"), F.sum(F.col("cells")[0]["text"].cast("long")), F.max("seq")).first()
    assert tuple(out) == (30_000, 30_000 * 29_999 // 2, 29_999)
