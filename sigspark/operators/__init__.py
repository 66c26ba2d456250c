"""Operators on traces, intervals, point processes and vectors."""
