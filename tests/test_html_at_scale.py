"""Plain cells read at once, and race pages without a shuffle."""

import os
import random
import sys

from tideline.sources import html as H

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_html import RESULT, frame  # noqa: E402

BITS = ["<tr>", "</tr>", "<td>a</td>", "<td> a \n b </td>", "<th>h</th>", "<td>&lt;x&amp;</td>", '<td>p <a href="?x=1&amp;y">L &amp; M</a> q</td>', "<td>J <b></td>", "<td>&am<b>p;</b></td>", '<td><a href="1"><a href="2">z</a></td>',
        "<td rowspan=3>r</td>", "<td rowspan=2 colspan=2>s</td>", "<td>open", "text", "</td>", "<table>", "</table>", "<!-- c -->", "<"]


def test_plain_cells_are_what_their_tags_say():
    r = random.Random(3)
    for _ in range(1500):
        page = "<table>" + "".join(r.choice(BITS) for _ in range(r.randrange(25)))
        slow = page.replace("<td>", "<td class=x>").replace("<th>", "<th class=x>").replace("<tr>", "<tr class=x>")  # attributes, so read tag by tag
        assert list(H.walk(page)) == list(H.walk(slow)), page


def test_race_pages_are_read_without_a_shuffle(spark):
    pages = frame(spark, RESULT, RESULT.replace("<td>WV</td>", "<th>x</th><td>3 DH</td>"))
    rows = H.race_results(pages, "page_id", "html", "day")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.page_id, r.finish_position, r.field_size, r.horse_id) for r in rows.orderBy("page_id", "finish_position").collect()] == [
        (0, 1, 2, "2024_K001"), (0, 2, 2, "J002"), (1, 1, 3, "2024_K001"), (1, 2, 3, "J002"), (1, 3, 3, "GAMMA_BOY")]


def test_headings_are_read_without_a_shuffle(spark):
    page = "<table id=t><tr><th>A</th><th>A</th><th></th><th>B</th><th>A</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><th>5</th></tr></table>"
    pages = frame(spark, page, None, "<table><tr><th>only</th></tr></table>", "<table><tr><td>none</td></tr></table>", "<table><tr><th> </th></tr><tr><td>x</td></tr></table>")
    rows = H.headed_tables(pages, "page_id")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    expected = [(0, "t", 1, {"A": "1", "A_2": "2", "B": "4"}), (0, "t", 2, {"A": "5"})]
    for got in (rows, H.headed(H.html_rows(pages, "page_id"), "page_id")):
        assert [(r.page_id, r.table_id, r.row, r["values"]) for r in got.orderBy("row").collect()] == expected
