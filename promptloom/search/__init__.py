"""Prompt search: a driver loop over DataFrames of records, samples and outcomes."""
