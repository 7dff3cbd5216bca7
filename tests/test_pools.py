"""Meetings, cards, pools and results from payloads written by hand."""

import json

import pytest

from tideline.sources import pools as P


def payloads(spark, *documents, key=None):
    rows = [(i if key is None else key[i], d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, f"{'n long' if key is None else 'race_id string'}, payload string")


def runner(no, code="", status="Declared", odds="4.5", **more):
    return {"no": no, "status": status, "winOdds": odds, "horse": {"code": code}, "barrierDrawNumber": "3", "currentRating": "x", **more}


CARD = {"data": {"raceMeetings": [{"date": "2026-07-15", "venueCode": "HV", "races": [
    {"no": 2, "distance": 1650, "raceTrack": {"description_en": "All Weather Track"}, "claCode": None, "raceClass_en": "Class 5", "postTime": "2026-07-15T18:30:00+08:00", "runners": [runner("1", "K001"), runner("2"), runner("11", "K003", "Scratched"), runner("4", "K004", odds="1.0"), runner("5", "K005", odds="SCR"), runner("6", "K006", "Withdrawn (vet)")]},
    {"no": None, "runners": [runner("1")]}, {"no": 3, "runners": None}]}, {"date": "2026-01-01", "venueCode": "ST", "races": [{"no": 9}]}]}}


def test_cards(spark):
    got = P.race_cards(payloads(spark, CARD, None, "", "{broken", {"data": {"raceMeetings": []}}), keep=("n",)).orderBy("race_number").collect()
    assert [(r.n, r.race_id, r.race_number) for r in got] == [(0, "HK:2026-07-15:HV:2", 2), (0, "HK:2026-07-15:HV:3", 3)]
    a, b = got
    assert (a.surface, a.race_class, a.distance, a.going, b.surface, b.distance, b.runners, b.win_odds) == ("AWT", "Class 5", 1650, "", "TURF", 0, [], {})
    assert a.win_odds == {"K001": 4.5, "02": 4.5}
    assert [(r.key, r.scratched, r.draw, r.rating, r.odds) for r in a.runners][2:5] == [("K003", True, 3, None, 4.5), ("K004", False, 3, None, 1.0), ("K005", False, 3, None, None)]


def pool(kind, status, *nodes):
    return {"oddsType": kind, "sellStatus": status, "oddsNodes": [{"combString": c, "oddsValue": v} for c, v in nodes]}


def document(*pools):
    return {"data": {"raceMeetings": [{"pmPools": list(pools)}]}}


def test_pools_never_price_scratched_runners(spark):
    races = P.race_cards(payloads(spark, CARD))
    quoted = document(pool("WIN", "STOP_SELL", ("1", "9.9")), pool("QIN", "AVAILABLE", ("1,2", "30")), pool("WIN", "available", ("01", "2.5"), ("2", "7"), ("11", "3.0"), ("4", "1.0"), ("5", "---"), ("06", "8"), ("13", "50"), ("1", "2.6")), pool("PLA", "AVAILABLE", ("1", "1.4")), pool("PLA", "AVAILABLE", ("11", "1.1")))
    got = {r.race_number: r for r in P.with_pools(races, payloads(spark, quoted, key=["HK:2026-07-15:HV:2"])).collect()}
    assert got[2].win_odds == {"K001": 2.6, "02": 7.0, "13": 50.0} and got[2].place_odds == {"K001": 1.4} and not got[2].pool_closed
    assert got[3].win_odds == {} and got[3].place_odds == {} and not got[3].pool_closed


@pytest.mark.parametrize(("status", "closed"), [("AVAILABLE", False), ("STOP_SELL", True), ("", True), (None, True)])
def test_a_pool_is_closed_unless_it_sells(spark, status, closed):
    races = P.race_cards(payloads(spark, CARD)).where("race_number = 2")
    got = P.with_pools(races, payloads(spark, document(pool("WIN", status, ("1", "3"))), key=["HK:2026-07-15:HV:2"])).first()
    assert got.pool_closed == closed and got.win_odds == {"K001": 3.0}
    kept = P.with_pools(races, payloads(spark, document(pool("WIN", status, ("1", "0.5"))), key=["HK:2026-07-15:HV:2"])).first()
    assert not kept.pool_closed and kept.win_odds == {"K001": 4.5, "02": 4.5}


def test_the_newest_open_meeting_is_selected(spark):
    m = lambda *rows: {"data": {"activeMeetings": [{"date": d, "venueCode": v, "status": s} for d, v, s in rows]}}
    got = P.active_meetings(payloads(spark, m(("2026-07-01", "ST", "open"), ("2026-07-08", "HV", "closed"), ("2026-07-05", "HV", None), ("", "X", "open"), ("2026-07-05", "ST", "x")), m(("2026-07-01", "ST", "CLOSED"), ("2026-07-02", "HV", "Closed")), m(), None), keep=("n",)).collect()
    assert len(got) == 6 and {(r.n, r.date, r.venue) for r in got if r.selected} == {(0, "2026-07-05", "HV"), (1, "2026-07-02", "HV")}


def test_the_last_final_result_counts(spark):
    result = lambda kind, stage, h, a: {"resultType": kind, "stageId": stage, "homeResult": h, "awayResult": a}
    match = lambda i, *results, at="2026-07-01T12:00:00Z": {"id": i, "kickOffTime": at, "status": "done", "results": list(results)}
    got = P.corner_results(payloads(spark, {"data": {"matches": [match("a", result(2, 5, 1, 1), result(1, 5, 9, 9), result(2, 5, 6, 3), result(2, 4, 0, 0)), match("b", result(2, 4, 1, 1)), match("", result(2, 5, 1, 1)), match("c", result(2, 5, 1, 1), at="soon"), match("d", result(2, 5, 1, 1), result(2, 5, 1, None)), match("e")]}}, None))
    assert [(r.match_id, r.home, r.away, r.status) for r in got.collect()] == [("a", 6, 3, "done")]
