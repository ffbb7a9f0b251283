"""Operators on DataFrames: neighbours, scores, profiles, findings, query making, embedding, merging."""
