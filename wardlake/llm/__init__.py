"""Operators of a training-data pipeline: whole tables in, one table of results out."""
