"""Operators on DataFrames: joins, windows, aggregates, ordered folds, models."""
