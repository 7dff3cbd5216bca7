"""Tideline: leakage-safe, time-ordered analytics on PySpark DataFrames."""
