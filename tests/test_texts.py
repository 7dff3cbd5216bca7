"""Draws of every shape, JSON in scripts, notes of absences: by hand."""

import json

from tideline.sources import texts as X


def payloads(spark, *rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "n long, payload string")


def test_draws_of_every_shape(spark):
    rows = [
        {"drawNumber": "24/001", "drawDate": "2024-01-02", "numbers": [9, 3, 1, 40, 22, 7], "specialNumber": 5, "totalTurnover": 12.5},
        {"DrawNo": "24/002", "date": "03/01/2024", "Numbers": "1, 2, 3, 44, 55 and 6 7", "SpecialNumber": "8"},
        {"id": "24003N", "drawDate": "2024-01-04+08:00", "drawResult": {"drawnNo": ["6", "5", "4", "3", "2", "1"], "xDrawnNo": "49"}, "lotteryPool": {"totalInvestment": "9000"}},
        {"id": "4", "DrawDate": "20240105", "drawNumbers": [1, 2, 3, 4, 5, 6, 7], "extraNumber": 0},
        {"id": "5", "date": "soon", "numbers": [], "Numbers": [1, 2, 3, 4, 5, 6]},
        {"numbers": [1, 2, 3, 4, 5, 6]}, {"id": "7", "numbers": [1, 2, 3, 4, 5]}, {"id": "8", "numbers": [1, 2, 3, 4, 5, "x"]}, {"id": "9", "numbers": [1, 2, 3, 4, 5, 6], "turnover": "much"}, "{broken", "", None,
    ]
    got = {r.n: r for r in X.draw_payloads(payloads(spark, *rows), keep=("n",)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert (got[0].draw_number, str(got[0].draw_date), got[0].numbers, got[0].special, got[0].turnover) == ("24/001", "2024-01-02", [1, 3, 7, 9, 22, 40], 5, 12.5)
    assert (got[1].numbers, str(got[1].draw_date), got[1].special) == ([1, 2, 3, 6, 7, 44], "2024-01-03", 8)
    assert (got[2].numbers, str(got[2].draw_date), got[2].special, got[2].turnover) == ([1, 2, 3, 4, 5, 6], "2024-01-04", 49, 9000.0)
    assert (got[3].numbers, str(got[3].draw_date), got[3].special) == ([1, 2, 3, 4, 5, 6], "2024-01-05", 0) and got[4].draw_date is None


def script(document, how):
    text = json.dumps(document, ensure_ascii=False)
    return f"<script>\nvar x = JSON.parse('{how(text)}'); var y = JSON.parse('no')</script>"


def test_json_in_scripts(spark):
    side = lambda title, **more: {"title": title, "xG": "1.5", "shots": "10", **more}
    matches = [{"date": "2026-01-02 15:00:00", "h": side("Alpha é \"A\" \\ B", shotOnTarget=4, deep=None, ppda=""), "a": side("Beta")}, {"date": "soon", "h": side("x"), "a": side("y")}, {"date": "2026-01-02", "h": side("x", shots="many"), "a": side("y")}, {"date": "2026-01-03", "h": side("x")}, {"h": side("x"), "a": side("y")}]
    hexed = lambda t: "".join(f"\\x{ord(c):02X}" if c in '{}[]":\\' else c for c in t)
    pages = [script(matches, hexed), script(matches, lambda t: t.replace("\\", "\\\\")), "<html>none</html>", None, "JSON.parse('{broken')"]
    rows = X.shot_records(spark.createDataFrame(list(enumerate(pages)), "n long, html string"), keep=("n",)).orderBy("n").collect()
    assert [r.n for r in rows] == [0, 1]
    for r in rows:
        assert (r.home_team, r.away_team, r.home_xg, r.home_shots, r.home_shots_on_target, r.home_deep, r.home_ppda, r.away_shots_on_target) == ('Alpha é "A" \\ B', "Beta", 1.5, 10, 4, 0, 0.0, 0) and str(r.date) == "2026-01-02 15:00:00"


def test_notes_of_absences(spark):
    page = "<p>球隊軍情</p><div>Alpha FC</div>停賽：A、B<br/>上陣成疑：／<br>受傷／缺陣：C，D, E<p>Beta</p>受傷／缺陣：-<p>Alpha FC</p>受傷／缺陣：&nbsp;Z 、／<p>軍情</p>受傷／缺陣：Q"
    inside = json.dumps({"body": page.replace("<", "\\u003c").replace(">", "\\u003e")}, ensure_ascii=False).replace("\\\\u", "\\u")
    got = X.absences(spark.createDataFrame([(0, page), (1, inside), (2, None), (3, "no notes")], "n long, html string"), keep=("n",)).collect()
    for n in (0, 1):
        assert sorted((r.team, r.suspended, r.doubtful, [x.rstrip('"}') for x in r.absent]) for r in got if r.n == n) == [("Alpha FC", [], [], ["Z"]), ("Beta", [], [], [])]
    assert {r.n for r in got} == {0, 1}
    one = X.absences(spark.createDataFrame([(page.split("<p>Alpha")[0],)], "html string")).where("team = 'Alpha FC'").first()
    assert (one.suspended, one.doubtful, one.absent) == (["A", "B"], [], ["C", "D", "E"])
