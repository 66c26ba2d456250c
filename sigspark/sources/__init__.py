"""Readers of recordings and event tables, as DataFrames with the columns of ``sigspark.model``."""
