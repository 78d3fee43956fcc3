"""Operators: functions that take and return DataFrames."""
