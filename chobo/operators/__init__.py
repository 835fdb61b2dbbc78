"""Operators on DataFrames: registry, verification, scoring, evaluation, corruption, extraction, synthesis."""
