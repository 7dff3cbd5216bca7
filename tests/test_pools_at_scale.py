"""Priced races: orders are worked out once, and payloads read once."""

from tideline.queries import QUERIES


def test_orders_are_worked_out_once(spark, data):
    plan = QUERIES["q_priced_races"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("from_json") <= 2
