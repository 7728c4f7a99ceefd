"""Operators over DataFrames: metadata, citations, ranking, fusion, resolution, evaluation, statistics, state."""
