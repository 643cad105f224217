"""Operators: functions from DataFrames to DataFrames.  None starts a job
unless its docstring says so."""
