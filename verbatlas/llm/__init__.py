"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads whole tables and whole texts, and sets no cap on the
rows of a key, source, bucket or group of copies.
"""
