"""Operators: functions from DataFrames to DataFrames, keyed by doc_id."""
