"""Operators on DataFrames of records, messages, events and dimensions."""
