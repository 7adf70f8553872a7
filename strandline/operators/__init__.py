"""Operators on DataFrames: history compression, combination, ledger questions, quality checks."""
