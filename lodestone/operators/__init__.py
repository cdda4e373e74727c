"""Retrieval operators: each takes DataFrames of many questions at once and returns one."""
