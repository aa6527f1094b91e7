"""Operators on DataFrames of alignments, evidence and results."""
